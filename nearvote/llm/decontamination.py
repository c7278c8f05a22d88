"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks.

An item is its weighted word shingles: each shingle's count times the logarithm of how
few items have it, by a count sketch over the whole benchmark. A document is compared
window by window, a window having as many words as the item, at every start. Running sums
over the places of an item's shingles give what each window shares with it, whatever the
order of its parts; windows that share too little are passed over, which loses none. The
others' SimHash is looked up in a multi-index: fingerprints are cut into radius + 1
blocks, and two within the radius agree in at least one whole block, so probing the blocks
misses none. Candidates within the radius are verified by the exact weighted Jaccard
similarity. At this radius the blocks rule out few items: the running sums do the pruning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.llm import common, text

_U = np.uint64
BITS = 64
#: Bits of the table that tells at a glance that a shingle is in no item.
GLANCE = 1 << 20
#: Cells of a row of the sketch of shingle frequencies, its rows, and the blocks it is shipped in.
SKETCH_CELLS, SKETCH_ROWS, SKETCH_BLOCKS = 1 << 20, 2, 32
#: More than the rounding of running sums moves a similarity.
SLACK = 1e-6


@dataclass(frozen=True)
class DecontaminationConfig:
    """``radius`` in bits: similar sets of 0.8 differ in about 10 of 64, with deviation 3.

    ``block_bytes`` bounds the benchmark text whose index is broadcast at a time (an index
    takes about 20 bytes for each of text); a larger benchmark is searched in several blocks
    of items, each against all documents. Weights are the same for any number of blocks.
    """

    k: int = 5
    threshold: float = 0.8
    radius: int = 22
    block_bytes: int = 4 << 20


def simhash(shingles: np.ndarray, weights: np.ndarray) -> int:
    """Bit b is set where the weights of the shingles that have it outweigh the others'."""
    signs = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
    return int.from_bytes(np.packbits(weights @ signs > 0).tobytes(), "big")


def blocks(fingerprint: int, count: int) -> list[tuple[int, int]]:
    """(block, value) for ``count`` nearly equal slices of the fingerprint."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(i, fingerprint >> a & ((1 << (b - a)) - 1)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


def sequence(hashes: np.ndarray, k: int) -> np.ndarray:
    """Shingles of a word sequence in order; a shorter one is its only shingle."""
    return text.chain(hashes, min(k, len(hashes))) if len(hashes) else hashes[:0]


def _cells(shingles: np.ndarray) -> list[np.ndarray]:
    return [((shingles >> _U(shift)) % _U(SKETCH_CELLS)).astype(np.int64) for shift in (40, 8)]


@dataclass(frozen=True)
class Frequencies:
    """Number of items with words, and a count sketch of how many of them have a shingle."""

    items: int
    sketch: np.ndarray

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """A shingle that no item has weighs what the rarest do."""
        having = np.minimum(*(row[at] for row, at in zip(self.sketch, _cells(shingles))))
        return np.log1p(self.items / np.maximum(having, 1))


def frequencies(items: DataFrame, config: DecontaminationConfig) -> Frequencies:
    """Counted over all (item, body) rows; what reaches the driver has a fixed size."""
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros((SKETCH_ROWS, SKETCH_CELLS), np.uint32), 0
        for batch in batches:
            for _, _, words in text.iterate(batch.column(1)):
                own = [s for s in text.shingle_sets(words, config.k) if s.size]
                n += len(own)
                for row, at in zip(cells, _cells(np.concatenate(own)) if own else ()):
                    row += np.bincount(at, minlength=SKETCH_CELLS).astype(np.uint32)
        parts = [*(p.tobytes() for p in cells.reshape(SKETCH_BLOCKS, -1)), np.array([n], np.uint32).tobytes()]
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "payload"])

    sums = common.add_up(items.select("item", "body").mapInArrow(scan, schema), "block", "payload", "<u4", "add", 16)
    sketch = np.zeros((SKETCH_BLOCKS, SKETCH_ROWS * SKETCH_CELLS // SKETCH_BLOCKS), np.uint32)
    for block in range(SKETCH_BLOCKS):
        if block in sums:
            sketch[block] = sums[block]
    return Frequencies(int(sums[SKETCH_BLOCKS][0]) if sums else 0, sketch.reshape(SKETCH_ROWS, SKETCH_CELLS))


class MultiIndex:
    """Fingerprints by the value of each of ``count`` blocks."""

    def __init__(self, prints: list[int], count: int):
        self.count = count
        self.table: dict[tuple[int, int], np.ndarray] = {}
        keyed = [blocks(p, count) for p in prints]
        for block in range(count):
            values = np.array([k[block][1] for k in keyed], np.int64)
            order = np.argsort(values, kind="stable").astype(np.int32)
            own, first = np.unique(values[order], return_index=True)
            for value, places in zip(own.tolist(), np.split(order, first[1:])):
                self.table[block, value] = places

    def near(self, fingerprint: int, place: int) -> bool:
        """Whether the fingerprint at ``place`` agrees with this one in a block."""
        for key in blocks(fingerprint, self.count):
            own = self.table.get(key)
            if own is not None and (at := int(np.searchsorted(own, place))) < len(own) and own[at] == place:
                return True
        return False


#: (shingle, item) pairs of a document that are looked at together.
EXPANDED = 1 << 20


class Index:
    """Items of one block of the benchmark, ready to search documents."""

    def __init__(self, ids: list[int], texts: list[str | None], config: DecontaminationConfig, known: Frequencies):
        self.config, self.weight = config, known.weight
        self.ids, self.lengths, self.bags, self.totals = [], [], [], []
        ordered = []
        for item, value in zip(ids, texts):
            words = text.Words(*text.buffers(pa.array([value or ""])))
            if len(words.hashes):
                self.ids.append(item)
                self.lengths.append(len(words.hashes))
                ordered.append(sequence(words.hashes, config.k))
        every = np.unique(np.concatenate(ordered)) if ordered else np.zeros(0, _U)
        self.vocabulary = every
        self.weights = self.weight(every)
        self.prints = []
        #: Of each item, its shingles' places in the vocabulary and how often it has them.
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        flat, times = [every[:0]], [np.zeros(0, np.int64)]
        for s in ordered:
            u, c = np.unique(s, return_counts=True)
            bag = c * self.weight(u)
            flat.append(u)
            times.append(c)
            self.bags.append((u, bag))
            self.own.append((np.searchsorted(every, u), c))
            self.totals.append(float(bag.sum()))
            self.prints.append(simhash(u, bag))
        self.index = MultiIndex(self.prints, config.radius + 1)
        # The items that have each shingle and how often, grouped by shingle.
        owner = np.repeat(np.arange(len(ordered)), [len(u) for u in flat[1:]])
        together = np.concatenate(flat)
        order = np.argsort(together, kind="stable")
        self.owner, self.times = owner[order], np.concatenate(times)[order]
        self.begin = np.searchsorted(together[order], every, "left")
        self.end = np.searchsorted(together[order], every, "right")
        self.glance = np.zeros(GLANCE, bool)
        self.glance[(every % _U(GLANCE)).astype(np.int64)] = True
        self.sizes = sorted({min(config.k, n) for n in self.lengths})

    def hits(self, words: text.Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle size, first words, vocabulary places) of the item shingles among all words."""
        found = []
        for k in self.sizes:
            runs = text.chain(words.hashes, k)
            maybe = np.flatnonzero(self.glance[(runs % _U(GLANCE)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, runs[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == runs[maybe]
            if same.any():
                found.append((k, maybe[same], at[same]))
        return found

    def search(self, hashes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, bits apart) of each item's best window.

        ``found``: places in ``hashes`` and in the vocabulary of the hits.
        """
        places, shingles = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((places, shingles))
        places, shingles = places[order], shingles[order]
        heavy: dict[int, np.ndarray] = {}
        config = self.config
        for i in self.reachable(shingles).tolist():
            own, times = self.own[i]
            first, last = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
            count = last - first
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place, shingle, times = places[at], shingles[at], np.repeat(times, count)
            weight = self.weights[shingle]
            size = min(config.k, self.lengths[i])
            if size not in heavy:
                heavy[size] = np.concatenate(([0.0], np.cumsum(self.weight(text.chain(hashes, size)))))
            near = self.window_similarities(i, place, shingle, times, weight, len(hashes), heavy[size])
            starts = np.flatnonzero(near >= config.threshold - SLACK)
            length = min(len(hashes), self.lengths[i])
            # The most similar first, of equals the earliest.
            for start in starts[np.lexsort((starts, -near[starts].round(9)))].tolist():
                u, c = np.unique(sequence(hashes[start : start + length], config.k), return_counts=True)
                bag = c * self.weight(u)
                print_ = simhash(u, bag)
                if not self.index.near(print_, i):
                    continue
                apart = (print_ ^ self.prints[i]).bit_count()
                similarity = self.similarity(i, u, bag)
                if apart <= config.radius and similarity >= config.threshold:
                    yield self.ids[i], similarity, start, length, apart
                    break

    def reachable(self, shingles: np.ndarray) -> np.ndarray:
        """The items whose weight in common with a document of these hits, sorted, reaches the threshold.

        A shingle counts as often as both have it, whatever its places: a template that many items
        share costs a row for each of them and no more, and rows are added up a slice at a time.
        Similarity is at most the share of the item's weight that is shared.
        """
        own, copies = np.unique(shingles, return_counts=True)
        count = self.end[own] - self.begin[own]
        upto = np.cumsum(count)
        shared = np.zeros(len(self.ids))
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - count[a] + EXPANDED, "right")))
            c = count[a:b]
            at = np.repeat(self.begin[own[a:b]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            both = np.minimum(self.times[at], np.repeat(copies[a:b], c)) * np.repeat(self.weights[own[a:b]], c)
            shared += np.bincount(self.owner[at], both, len(shared))
            a = b
        return np.flatnonzero(shared >= (self.config.threshold - SLACK) * np.array(self.totals))

    def window_similarities(self, i: int, place: np.ndarray, shingle: np.ndarray, times: np.ndarray, weight: np.ndarray, n: int, heavy: np.ndarray) -> np.ndarray:
        """Similarity to item ``i``, but for rounding, of its windows at every start in ``n`` words.

        ``place``, ``shingle``, ``times`` and ``weight``: the item's shingles in the document,
        by shingle and place, and how often the item has them; ``heavy``: running sum of the
        weights of all shingles of the document.
        """
        length = min(n, self.lengths[i])
        runs = length - min(self.config.k, self.lengths[i]) + 1
        starts = n - length + 1
        # In a window that holds ``times`` earlier copies of a shingle a further one shares nothing.
        at = np.arange(len(place)) - times
        repeated, at = at >= 0, np.maximum(at, 0)
        repeated &= shingle[at] == shingle
        low = np.maximum(np.maximum(place - runs + 1, 0), np.where(repeated, place[at] + 1, 0))
        high = np.minimum(place, starts - 1) + 1
        some = low < high
        steps = np.bincount(low[some], weight[some], starts + 1) - np.bincount(high[some], weight[some], starts + 1)
        shared = np.cumsum(steps)[:starts]
        return shared / (self.totals[i] + heavy[runs : runs + starts] - heavy[:starts] - shared)

    def similarity(self, i: int, shingles: np.ndarray, bag: np.ndarray) -> float:
        """Sum of the lesser weights over the sum of the greater ones."""
        own, weights = self.bags[i]
        _, a, b = np.intersect1d(own, shingles, assume_unique=True, return_indices=True)
        shared = np.minimum(weights[a], bag[b]).sum()
        return float(shared / (weights.sum() + bag.sum() - shared))


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, bits_apart), one row per document and item.

    Of an item's windows in a document the most similar counts, the first of equals.
    Documents and items without words match nothing; an item of fewer than ``k`` words is
    one shingle; a document shorter than an item is one window. Rows that repeat an id are
    searched one by one; an empty benchmark finds nothing. A null item id is reported as -1.
    """
    rows = common.documents(docs, id_col, text_col).where("text is not null")
    out = None
    for last, shared in _indexes(benchmark, config, item_col, item_text_col):
        found = _search(rows, shared)
        if not (last and out is None):  # one block's index at a time: its matches are written
            found = common.store(found, f"{common.shared_dir(docs.sparkSession)}/matches")
            shared.unpersist()
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a window that is similar to an item, each judged by its own text.

    All columns stay, whatever their names; null and repeated ids don't matter. Rows without
    words stay. With several blocks of items, what each leaves is written for the next one.
    """
    spark = docs.sparkSession
    at, schema, path = docs.columns.index(text_col), docs.schema, None
    for number, (last, shared) in enumerate(_indexes(benchmark, config, item_col, item_text_col), 1):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, *_ in matches(shared.value, batch.column(at)):
                    clean[row] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
        if not last:
            path = path or common.shared_dir(spark)
            docs = common.store(docs, f"{path}/left{number}")
            shared.unpersist()
    return docs


def _indexes(benchmark: DataFrame, config: DecontaminationConfig, item_col: str, item_text_col: str) -> Iterator[tuple]:
    """(whether it is the last, the broadcast index) of every block of items, of about ``block_bytes``
    of text, each built when it is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("body")).where("body is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // config.block_bytes))
    known = frequencies(items, config)
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part)
        got = sorted((r["item"] if r["item"] is not None else -1, r["body"]) for r in own.collect())  # about block_bytes
        yield part == parts - 1, spark.sparkContext.broadcast(Index([i for i, _ in got], [b for _, b in got], config, known))


def matches(index: Index, column: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, similarity, first word, words, bits apart) of the texts in ``column``."""
    if not len(index.vocabulary):
        return
    for a, _, words in text.iterate(column):
        by_row: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, places, shingles in index.hits(words):
            row = np.searchsorted(words.first, places, "right") - 1
            # A run of words across two documents is no shingle.
            inside = places + k <= words.first[row + 1]
            row, places, shingles = row[inside], places[inside], shingles[inside]
            for r in np.unique(row).tolist():
                own = row == r
                by_row.setdefault(r, []).append((places[own] - words.first[r], shingles[own]))
        for r, hits in sorted(by_row.items()):
            for found in index.search(words.hashes[words.first[r] : words.first[r + 1]], hits):
                yield a + r, *found


def _search(rows: DataFrame, shared) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("bits_apart", T.IntegerType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("bits_apart", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            found = [(ids[row].as_py(), *x) for row, *x in matches(shared.value, batch.column(1))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 6, arrow)], schema=arrow)

    return rows.select("id", "text").mapInArrow(scan, schema)
