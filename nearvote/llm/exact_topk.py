"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A component is a term, its whole-number value a weight. A task turns each batch of vectors into
posting lists, one per term; every query row then goes through its non-zero terms and
scatters their weighted postings into a dense array of scores, one per vector of the batch. A
partition selection takes the batch's best, which are merged with those of the batches
before, so a task passes on k rows a query. Queries are broadcast in blocks of a checked size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


@dataclass(frozen=True)
class TopKConfig:
    """``block_bytes`` of query vectors are broadcast at a time; ``rows`` vectors share posting lists."""

    k: int = 5
    scale: int = 256
    block_bytes: int = 32 << 20
    rows: int = 1 << 13


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *more: Column) -> DataFrame:
    """(id, vec, ...) of the rows with an id and a vector of finite components only."""
    vec = vectors[vec_col].cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(vectors[id_col].isNotNull() & vec.isNotNull() & good).select(vectors[id_col].cast("long").alias("id"), vec.alias("vec"), *more)


def whole(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, kept as doubles: exact at any size for a power of two."""
    return F.transform(vec, lambda x: _floor(x * F.lit(float(scale))))


def _floor(x: Column) -> Column:
    """floor as a double; the built-in one returns a long and fails beyond its range."""
    return F.rint(x) - (F.rint(x) > x).cast("double")


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, component, value) of the non-zero components of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(value)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(value)
    return row[some], term[some], value[some]


def exact(value: np.ndarray, dtype: type) -> np.ndarray:
    """Whole doubles as ``dtype``; as Python integers for ``object``."""
    return np.array([int(x) for x in value.tolist()] or [], object) if dtype is object else value.astype(dtype)


def score_type(heaviest: float, largest: float) -> type:
    """The least type that holds every partial sum of queries of absolute sum ``heaviest``."""
    most = heaviest * largest * (1 + 1e-9)
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


class Postings:
    """Posting lists of a batch of vectors: of each term the vectors and weights.

    A list that most vectors are on is kept as a whole column, zeros included, and needs no places.
    """

    def __init__(self, column: pa.Array, dtype: type):
        row, term, value = rows_of(column)
        self.rows, self.dtype = len(column), dtype
        order = np.argsort(term, kind="stable")
        row, term, value = row[order], term[order], exact(value[order], dtype)
        names, first = np.unique(term, return_index=True)
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
            if 2 * (b - a) > self.rows:
                full = np.zeros(self.rows, dtype)
                full[row[a:b]] = value[a:b]
                self.lists[t] = (None, full)
            else:
                self.lists[t] = (row[a:b], value[a:b])

    def accumulate(self, terms: list[int], weights: list) -> np.ndarray:
        """The dense scores of one query."""
        scores = np.zeros(self.rows, self.dtype)
        for t, w in zip(terms, weights):
            if t in self.lists:
                at, value = self.lists[t]
                if at is None:
                    scores += value * w
                else:
                    scores[at] += value * w
        return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> np.ndarray:
    """Places of the k best of a batch that reach ``least``, by (highest score, lowest id)."""
    at = np.flatnonzero(scores >= least)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        above = at[scores[at] > kth]
        tied = at[scores[at] == kth]
        need = k - len(above)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        at = np.concatenate([above, tied])
    return at


FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def search_block(queries: pa.Table, vectors: DataFrame, first: int, config: TopKConfig) -> DataFrame:
    """(query, query_id, vec_id, score): each task's k best for the queries, numbered from ``first``."""
    qids = queries.column("id").to_numpy()
    row, term, weight = rows_of(queries.column("vec"))
    cuts = np.searchsorted(row, np.arange(len(qids) + 1))
    heaviest = float(np.bincount(row, np.abs(weight), minlength=1).max()) if len(row) else 0.0
    shared = vectors.sparkSession.sparkContext.broadcast((qids, term, weight, cuts, heaviest))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, term, weight, cuts, heaviest = shared.value
        best_ids = [np.zeros(0, np.int64)] * len(qids)
        best = [np.zeros(0, object)] * len(qids)
        by_type: dict[type, list[list]] = {}
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, config.rows):
                batch = whole_batch.slice(start, config.rows)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                dtype = score_type(heaviest, float(np.abs(values).max()) if len(values) else 0.0)
                if dtype not in by_type:
                    flat = exact(weight, dtype).tolist()
                    by_type[dtype] = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                postings = Postings(batch.column(1), dtype)
                places = {int(q): np.flatnonzero(ids == q) for q in np.intersect1d(qids, ids)}
                for i, q in enumerate(qids.tolist()):
                    scores = postings.accumulate(term[cuts[i] : cuts[i + 1]].tolist(), by_type[dtype][i])
                    old = best[i]
                    least = old[-1] if len(old) == config.k else -math.inf
                    if q in places:  # the query's own row
                        own = places[q]
                        others = np.delete(np.arange(len(ids)), own)
                        at = others[select(scores[others], ids[others], config.k, least)]
                    else:
                        at = select(scores, ids, config.k, least)
                    if len(at):
                        all_ids, all_scores = np.concatenate([best_ids[i], ids[at]]), np.concatenate([old, scores[at].astype(object)])
                        order = sorted(range(len(all_ids)), key=lambda j: (-all_scores[j], all_ids[j]))[: config.k]
                        best_ids[i], best[i] = all_ids[order], all_scores[order]
        at = np.repeat(np.arange(len(qids)), [len(b) for b in best])
        found = [int(s) for b in best for s in b]  # a score beyond 64 bits is an error
        yield pa.record_batch([pa.array(at + first, pa.int64()), pa.array(qids[at], pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *best_ids]), pa.int64()), pa.array(found, pa.int64())], names=FOUND.names)

    return vectors.select("id", "vec").mapInArrow(scan, FOUND)


def exact_top_k(vectors: DataFrame, is_query: Column, config: TopKConfig = TopKConfig(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest whole-number inner products.

    Queries are the rows for which ``is_query`` holds, candidates all rows but those of the
    query's own id; ties go to the lower id. Rows without an id or a vector, or with a null or
    non-finite component, take no part; an empty vector scores 0 everywhere and of vectors
    of unequal length the missing components are 0. Where queries repeat an id, each has
    ranks of its own. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, is_query.alias("is_query"))
    rows = rows.select("id", whole(F.col("vec"), config.scale).alias("vec"), "is_query")
    queries = rows.where("is_query").select("id", "vec")
    held = queries.agg(F.coalesce(F.sum(F.size("vec") * 8 + 16), F.lit(0))).first()[0]
    parts = max(1, math.ceil(held / config.block_bytes))
    out = spark.createDataFrame([], FOUND)
    for part in range(parts):
        block = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).toArrow()
        if block.num_rows:
            out = out.unionByName(search_block(block, rows, part << 32, config))
    order = W.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")
