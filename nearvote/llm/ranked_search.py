"""Ranked lexical search by a bit-sliced impact index.

A posting's impact is its term's weight times a saturating function of its frequency, a
whole number. Documents are taken in blocks; in a block a term's impacts are kept as
bit slices, one bitmap over the documents for each bit, with only those 64-document words
that hold the term. An item's scores are the sum of its terms' slices by bitwise carries,
for all documents of the block at once, and its best documents are found from the
most significant slice down.

Two passes over the corpus: the first keeps of each document its length and the frequencies
of the terms that items ask for, from which the statistics of the whole corpus come; the
second builds the slices and keeps k documents an item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from nearvote.llm import common
from nearvote.llm.text import iterate

#: Bytes that terms are made of: ASCII letters and digits, and all of non-ASCII characters.
TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@dataclass(frozen=True)
class RankConfig:
    """``block_docs`` documents share bitmaps; ``block_pairs`` (item, term) pairs, 16 bytes each,
    are searched at a time, more in further blocks of items."""

    k: int = 10
    block_docs: int = 1 << 14
    block_pairs: int = 1 << 20


@dataclass(frozen=True)
class Items:
    """A block of items: ids, the ascending term hashes of all, each item's places among them."""

    ids: pa.Array
    terms: np.ndarray
    wanted: list[np.ndarray]


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, their terms with repeats, and the weights of the items' terms."""

    documents: int
    total: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Whole-number impacts of the postings (row, term, tf) of documents with ``n`` terms."""
        if len(n) and 90 * int(n.max()) * self.documents >= 1 << 63:
            n = n.astype(object)
        m = (10 + 90 * n * self.documents // max(self.total, 1)).astype(np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct term hashes of each item; rows that share an id are one item."""
    schema = "item long, term long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in iterate(batch.column(1), inside=TERM):
                at = words.rows() + a
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(words.hashes.view(np.int64))], names=["item", "term"])

    return items.select(items[id_col].cast("long").alias("item"), items[text_col].alias("text")).mapInArrow(split, schema).distinct()


def item_blocks(pairs: DataFrame, limit: int) -> Iterator[Items]:
    """The items in blocks of about ``limit`` pairs, which alone come to the driver."""
    parts = max(1, math.ceil(pairs.count() / limit))
    for part in range(parts):
        some = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        table = some.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        coded = table.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        owner = coded.indices.to_numpy()
        terms, place = np.unique(table.column("term").to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((place, owner))
        cuts = np.searchsorted(owner[order], np.arange(1, len(coded.dictionary)))
        yield Items(coded.dictionary, terms, np.split(place[order], cuts))


POSTINGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def postings(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with a term: its length and its frequencies of the asked ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, words in iterate(batch.column(1), inside=TERM):
                n = words.counts()
                place = np.searchsorted(known, words.hashes)
                hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == words.hashes)
                key, tf = np.unique(words.rows()[hit] * len(known) + place[hit], return_counts=True)
                row, term = np.divmod(key, len(known))
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                whole = pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n), *lists], names=POSTINGS.names)
                yield whole.filter(pa.array(n > 0))

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(count, POSTINGS)


class Slices:
    """The bit-sliced impacts of one block of documents."""

    def __init__(self, rows: int, term: np.ndarray, row: np.ndarray, impact: np.ndarray):
        self.words = -(-rows // 64)
        order = np.argsort(term, kind="stable")  # rows ascend within a term
        self._row, self._impact = row[order], impact[order]
        names, first = np.unique(term[order], return_index=True)
        self._span = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        self._built: dict[int, tuple[np.ndarray | slice, np.ndarray, int]] = {}

    def term(self, term: int) -> tuple[np.ndarray | slice, np.ndarray, int] | None:
        """(words, slices, largest impact): the slices of a term in the words that hold it."""
        if term not in self._span:
            return None
        if term not in self._built:
            a, b = self._span[term]
            row, impact = self._row[a:b], self._impact[a:b]
            at, first = np.unique(row >> 6, return_index=True)
            most = int(impact.max())
            bits = np.zeros((most.bit_length(), len(at)), np.uint64)
            place = (row & 63).astype(np.uint64)
            for i in range(len(bits)):
                bits[i] = np.bitwise_or.reduceat(((impact >> i) & 1).astype(np.uint64) << place, first)
            self._built[term] = (slice(None) if len(at) == self.words else at, bits, most)
        return self._built[term]

    def add(self, terms: list[int]) -> np.ndarray:
        """The bit slices of the sum of the terms' impacts, by ripple carries."""
        parts = [p for p in map(self.term, terms) if p is not None and p[2]]
        total = np.zeros((sum(p[2] for p in parts).bit_length(), self.words), np.uint64)
        for at, bits, _ in parts:
            carry = np.zeros(bits.shape[1], np.uint64)
            for i in range(len(total)):
                x = total[i, at]  # may be a view: read before it is written
                if i < len(bits):
                    either = x ^ bits[i]
                    both, carried = x & bits[i], carry & either
                    total[i, at] = either ^ carry
                    carry = both | carried
                else:
                    if not carry.any():
                        break
                    both = x & carry
                    total[i, at] = x ^ carry
                    carry = both
        return total


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(total: np.ndarray, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k highest sums above 0, from the most significant slice down.

    ``sure`` holds documents above the k-th sum, ``tied`` those equal to it so far; of the
    tied the least in ``rank`` are taken.
    """
    sure = np.zeros(total.shape[1], np.uint64)
    tied = np.bitwise_or.reduce(total, axis=0) if len(total) else sure
    for bits in total[::-1]:
        more = sure | (tied & bits)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied = tied & bits
        else:
            sure, tied = more, tied & ~bits
            if n == k:
                tied = np.zeros_like(tied)
                break
    place = _places(sure)
    left = _places(tied)
    if len(left) > k - len(place):
        left = left[np.argsort(rank[left])[: k - len(place)]]
    place = np.concatenate([place, left])
    score = np.zeros(len(place), np.int64)
    for i, bits in enumerate(total):
        score |= ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
    return place, score


def _best(owner: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best rows: highest score, then lowest id, null ids last."""
    order = np.lexsort((ids, no_id, -score, owner))
    own = owner[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def rank_block(items: Items, corpus: Corpus, postings: DataFrame, config: RankConfig) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task for every item of the block."""
    shared = postings.sparkSession.sparkContext.broadcast((items, corpus))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus = shared.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for block in _rows(batches, config.block_docs):
            valid = block.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = block.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            n = block.column(1).to_numpy(zero_copy_only=False)
            terms, tfs = block.column(2), block.column(3)
            row = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy(zero_copy_only=False))
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
            slices = Slices(len(n), term, row, corpus.impacts(n, row, term, tf))
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((ids, valid))] = np.arange(len(n))
            found = [top(slices.add(wanted.tolist()), config.k, rank) for wanted in items.wanted]
            owner = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            place = np.concatenate([p for p, _ in found])
            kept = [np.concatenate(x) for x in zip(kept, (owner, np.concatenate([s for _, s in found]), valid[place], ids[place]))]
            best = _best(*kept, config.k)
            kept = [x[best] for x in kept]
        owner, score, no_id, ids = kept
        yield pa.record_batch([items.ids.take(pa.array(owner)), pa.array(ids, mask=no_id), pa.array(score)], names=["item_id", "doc_id", "score"])

    return postings.mapInArrow(search, "item_id long, doc_id long, score long")


def _rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in record batches of ``limit`` rows, the last with what is left."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        while have + batch.num_rows >= limit:
            head = batch.slice(0, limit - have)
            yield pa.concat_batches([*held, head])
            batch, held, have = batch.slice(limit - have), [], 0
        if batch.num_rows:
            held.append(batch)
            have += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def rank_documents(docs: DataFrame, items: DataFrame, config: RankConfig = RankConfig(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Null and empty texts have no terms; such documents count nowhere and such items have no
    rows. Every row of ``docs`` is a document, also rows that are equal or repeat an id; ties
    go to the lower id, null ids last. Rows of ``items`` that share an id are one item with
    the terms of all; a null id is an id too. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    out = None
    for block in item_blocks(item_terms(items, item_col, item_text), config.block_pairs):
        held = common.store(postings(docs, block.terms, id_col, text_col), f"{common.shared_dir(spark)}/postings")
        documents, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(block.terms), np.int64)  # a term that no document holds is never read
        weights[counted.column("term").to_numpy()] = [weight(documents, df) for df in counted.column("count").to_pylist()]
        part = rank_block(block, Corpus(documents, total, weights), held, config)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k).select("item_id", "rank", "doc_id", "score")
