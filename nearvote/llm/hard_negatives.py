"""Hard negatives of anchors, by k-means inverted lists with stored centroid radii.

Vectors become whole numbers and are listed under their nearest centroid; of each list the radius
is stored. By Cauchy and Schwarz a member's inner product with an anchor lies within
|anchor| * radius of the centroid's. An anchor visits the lists by that upper bound: first for its
positives, the highest scores of its own label; then, once for all positives, for the highest
scores of other labels inside each positive's window. A list whose bounds lie outside every window is
skipped, and a window is done when the bound falls strictly below its k-th score. So the result
equals brute force for any clustering; the centroids only decide how much is skipped.

The visits go in rounds by ``operators.routed``: pairs of anchors and lists are shuffled, no
anchor comes to the driver, large lists and lists that many anchors want are dealt over cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.llm import common
from nearvote.llm.exact_topk import usable, whole
from nearvote.operators.routed import LEAST, MOST, InnerProduct, RoutedConfig, RoutedStats, inverted_lists, matrix, search


@dataclass(frozen=True)
class NegativesConfig:
    """A negative's score is ``low`` to ``high`` percent of its positive's. Centroids (half the root
    of the number of rows, ``max_lists`` at most) are fitted on the ``sample_rows`` rows with the
    least hashes of their ids; all rows are listed."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample_rows: int = 8192
    fit_rounds: int = 6
    max_lists: int = 4096
    routed: RoutedConfig = RoutedConfig()


def fit_centroids(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Whole-number centroids after Lloyd rounds on the sample, from evenly spaced distinct rows."""
    _, first = np.unique(sample, axis=0, return_index=True)
    distinct = sample[np.sort(first)]
    lists = min(lists, len(distinct))
    centroids = distinct[np.arange(lists) * len(distinct) // max(lists, 1)].astype(np.float64)
    points = sample.astype(np.float64)
    for _ in range(rounds):
        nearest = np.argmin((centroids * centroids).sum(axis=1)[None, :] - 2 * (points @ centroids.T), axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        size = np.bincount(nearest, minlength=lists)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return np.unique(np.rint(centroids), axis=0)


def listed(rows: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(ref_id, mark, cluster_id, q, far): each row with its nearest centroid and the distance to it, rounded up."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    kind = rows.schema["q"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        squares = (c * c).sum(axis=1)
        for batch in batches:
            q = matrix(batch.column(2), dims).astype(np.float64)
            own = np.concatenate([np.argmin(squares[None, :] - 2 * (q[a : a + 1024] @ c.T), axis=1) for a in range(0, len(q), 1024)] or [np.zeros(0, np.int64)])
            step = q - c[own]
            far = np.sqrt((step * step).sum(axis=1)) * (1 + 1e-9) + 1e-6
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.int32()), batch.column(2), pa.array(far)], names=["ref_id", "mark", "cluster_id", "q", "far"])

    return rows.select(F.col("id").alias("ref_id"), F.col("label").alias("mark"), "q").mapInArrow(nearest, f"ref_id long, mark int, cluster_id int, q {kind}, far double")


def _percent(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score, rounded down or up, in whole numbers."""
    sign = -1 if up else 1
    x = score * F.lit(sign * percent)
    return F.lit(sign) * F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, config: NegativesConfig = NegativesConfig(), id_col: str = "vec_id", vec_col: str = "embedding", stats: tuple[RoutedStats, RoutedStats] | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part;
    an empty table gives no rows. Rows that repeat an id are one: that of the least label, then
    the least vector. Missing components of shorter vectors are 0. Equal scores go to the
    lower id. A positive without a negative in its window has no rows; a negative score of a
    positive has an empty window. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    path = common.shared_dir(spark)
    rows = usable(vectors, id_col, vec_col, label.cast("int").alias("label"), is_anchor.alias("anchor")).where("label is not null")
    rows = common.store(rows.select("id", "label", "anchor", whole(F.col("vec"), config.scale).alias("vec")), f"{path}/rows")
    n, ids, dims, largest = rows.agg(F.count("*"), F.countDistinct("id"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("vec", F.abs))), F.lit(0.0))).first()
    if not n or not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kind = "int" if largest < 2**31 else "bigint"
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vec"))).cast(f"array<{kind}>")
    rows = rows.select("id", "label", "anchor", padded.alias("q"))
    if ids < n:
        rows = common.store(rows.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("id", "r.*"), f"{path}/distinct")

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(config.sample_rows).select("q").toArrow()
    lists = max(1, min(config.max_lists, round(math.sqrt(ids) / 2)))
    centroids = fit_centroids(matrix(sample.column("q"), dims), lists, config.fit_rounds)
    members = common.store(listed(rows, centroids, dims), f"{path}/members")
    radii = {r[0]: r[1] for r in members.groupBy("cluster_id").agg(F.max("far")).collect()}  # a row a list
    known = np.array(sorted(radii))
    metric = InnerProduct(known, centroids[known], np.array([radii[c] for c in known.tolist()]))
    packed = common.store(inverted_lists(members.drop("far"), config.routed), f"{path}/lists")

    anchors = rows.where("anchor").select(F.col("id").alias("qid"), "q", F.col("label").alias("mark"))
    open_ = anchors.select("*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    first, second = stats or (None, None)
    found = search(open_, packed, metric, dims, config.positives, same_mark=True, config=config.routed, stats=first)
    positives = common.store(found.select("qid", (F.col("rk") - 1).alias("slot"), F.col("ref_id").alias("positive_id"), F.col("score").alias("positive_score")), f"{path}/positives")

    window = F.struct("slot", _percent(F.col("positive_score"), config.low, True).alias("low"), _percent(F.col("positive_score"), config.high, False).alias("high"))
    windows = positives.groupBy("qid").agg(F.array_sort(F.collect_list(window)).alias("w"))  # a few an anchor
    empty = F.lit(config.positives) - F.size("w")
    bounded = anchors.join(windows, "qid").select("qid", "q", "mark", F.concat(F.col("w.low"), F.array_repeat(F.lit(1).cast("long"), empty)).alias("lows"), F.concat(F.col("w.high"), F.array_repeat(F.lit(0).cast("long"), empty)).alias("highs"))
    negatives = search(bounded, packed, metric, dims, config.negatives, slots=config.positives, same_mark=False, config=config.routed, stats=second)
    ranked = negatives.select("qid", "slot", F.col("rk").alias("rank"), F.col("ref_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(positives, ["qid", "slot"]).select(F.col("qid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
