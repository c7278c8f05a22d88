"""LM scoring: prediction by partial matching over a byte-context trie.

The trie holds, for every context of up to ``order`` bytes, the bytes that followed it in
the training texts and how often. A byte's probability is that of its longest known
context; where the context has not seen the byte, an escape is paid (method C: as
many escape counts as distinct bytes seen) and the next shorter context decides, without the
bytes that the longer one has already ruled out (symbol exclusion). Below the empty
context all bytes left are equally likely. Byte 0xFF, which UTF-8 never has, pads the
start and ends a text, so a text's code length is that of a complete message.

Counts are gathered over all training texts. A node is a packed byte string with its
count, and shorter contexts are sums of longer ones, so only the deepest level is counted.
All nodes count. A trie of up to ``max_nodes`` is broadcast; of a larger one only the exact
prices of its most frequent nodes are, and the other grams of the texts meet the nodes
in a shuffle by the two bytes before the priced one, which leaves every longer context whole;
pairs of bytes with more than ``max_cell`` nodes are dealt by a third byte.
Likewise the ``max_words`` most frequent words are broadcast and others joined by a shuffle, so
no key that many texts have is shuffled.
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
EDGE = 0xFF
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LmConfig:
    """``order``: longest context in bytes (7 at most). ``max_nodes`` bounds the deepest level
    of a broadcast trie, ``max_words`` a broadcast word table; what is beyond them is joined
    by a shuffle. ``max_cell``: nodes after one pair of bytes that a task may hold together."""

    order: int = 4
    max_nodes: int = 1 << 21
    max_words: int = 1 << 22
    max_cell: int = 1 << 20
    slot_bits: int = 22


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) of every byte and text end, and the row of each."""
    n, rows = len(data), len(offsets) - 1
    lengths = np.diff(offsets)
    # Each text stands between ``order`` edge bytes and one more.
    out = np.full(n + rows * (order + 1), EDGE, np.uint8)
    row = np.repeat(np.arange(rows), lengths)
    out[np.arange(n) + row * (order + 1) + order] = data
    coded = np.zeros(len(out), _U)
    for j in range(order + 1):
        coded[order:] |= out[order - j : len(out) - j].astype(_U) << _U(8 * j)
    owner = np.repeat(np.arange(rows), lengths + order + 1)
    start = offsets[:-1] + np.arange(rows) * (order + 1)
    real = np.arange(len(out)) - start[owner] >= order
    return coded[real], owner[real]


class Trie:
    """Nodes by level, with what is needed to price a byte; level k has contexts of k bytes.

    ``low``: (keys, values) of the first levels, where ``nodes`` are only those of some contexts;
    ``split``: those of the next level for contexts whose nodes are not all here.
    """

    def __init__(self, nodes: np.ndarray, counts: np.ndarray, config: LmConfig, low: list[tuple[np.ndarray, np.ndarray]] | None = None, split: tuple[np.ndarray, np.ndarray] | None = None):
        self.config = config
        order = config.order
        self.keys, self.values, self.contexts, self.totals, self.kinds = [], [], [], [], []
        self.excluded, self.excluded_kinds = [], []
        for k in range(order + 1):
            if k < len(low or ()):
                keys, values = low[k]
            else:
                keys, values = _summed(nodes, counts, k)
            if split is not None and k == len(low or ()):
                keys, values = _completed(keys, values, *split)
            contexts, at, kinds = np.unique(keys >> _U(8), return_index=True, return_counts=True)
            totals = np.add.reduceat(values, at) if len(at) else np.zeros(0)
            self.keys.append(keys)
            self.values.append(values)
            self.contexts.append(contexts)
            self.totals.append(totals)
            self.kinds.append(kinds.astype(np.float64))
        for k in range(order):
            # What the contexts of level k + 1 take out of their suffix at level k.
            longer = self.keys[k + 1]
            found = _find(self.keys[k], longer & _U((1 << 8 * (k + 1)) - 1))
            owner = np.searchsorted(self.contexts[k + 1], longer >> _U(8))
            self.excluded.append(np.bincount(owner, self.values[k][found], len(self.contexts[k + 1])) if len(longer) else np.zeros(0))
            self.excluded_kinds.append(self.kinds[k + 1])
        if low is None:
            self._fill_slots()

    def _fill_slots(self) -> None:
        """Direct-mapped table of the deepest level; frequent nodes take their slots first."""
        order = self.config.order
        keys, values = self.keys[order], self.values[order]
        self.slots = np.full(1 << self.config.slot_bits, np.iinfo(np.uint64).max, _U)
        self.prices = np.zeros(1 << self.config.slot_bits, np.float32)
        if not len(keys):
            return
        chosen, slot = _winners(keys, values, self.config.slot_bits)
        context = np.searchsorted(self.contexts[order], keys[chosen] >> _U(8))
        self.slots[slot] = keys[chosen]
        self.prices[slot] = np.log10(values[chosen] / (self.totals[order][context] + self.kinds[order][context]))

    def price(self, coded: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed gram after the bytes before it."""
        slot = _slot(coded, self.config.slot_bits)
        out = self.prices[slot].astype(np.float64)
        slow = np.flatnonzero(self.slots[slot] != coded)
        out[slow] = self.walk(coded[slow])
        return out

    def walk(self, coded: np.ndarray) -> np.ndarray:
        """``price`` by escaping down the levels."""
        out = np.zeros(len(coded))
        at = np.arange(len(coded))
        # Place of the context one level up, or -1 where that context is unknown.
        above = np.full(len(coded), -1)
        for k in range(self.config.order, -1, -1):
            if not at.size:
                return out
            own = coded[at] & _U((1 << 8 * (k + 1)) - 1)
            context = _find(self.contexts[k], own >> _U(8))
            known = context >= 0
            total = np.where(known, self.totals[k][context] if len(self.totals[k]) else 0.0, 0.0)
            kinds = np.where(known, self.kinds[k][context] if len(self.kinds[k]) else 0.0, 0.0)
            if k < self.config.order:
                ruled = above >= 0
                total = total - np.where(ruled, self.excluded[k][above] if len(self.excluded[k]) else 0.0, 0.0)
                kinds = kinds - np.where(ruled, self.excluded_kinds[k][above] if len(self.excluded_kinds[k]) else 0.0, 0.0)
            node = _find(self.keys[k], own)
            hit = node >= 0
            out[at[hit]] += np.log10(self.values[k][node[hit]] / (total[hit] + kinds[hit]))
            miss = ~hit
            escape = miss & (kinds > 0.5)
            out[at[escape]] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            at, above = at[miss], context[miss]
        left = 256 - (len(self.keys[0]) if len(self.keys) else 0)
        out[at] -= np.log10(max(1, left))
        return out


class Prices:
    """Exact prices of the most frequent nodes of a trie that is too large to be broadcast."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, prices: np.ndarray, config: LmConfig):
        self.config = config
        order = np.argsort(keys)
        self.keys, self.known = keys[order], prices[order]
        self.slots = np.full(1 << config.slot_bits, np.iinfo(np.uint64).max, _U)
        self.prices = np.zeros(1 << config.slot_bits, np.float32)
        chosen, slot = _winners(keys, counts, config.slot_bits)
        self.slots[slot], self.prices[slot] = keys[chosen], prices[chosen]

    def price(self, coded: np.ndarray) -> np.ndarray:
        """As a trie's, NaN for a gram that is not among the nodes."""
        slot = _slot(coded, self.config.slot_bits)
        out = self.prices[slot].astype(np.float64)
        slow = np.flatnonzero(self.slots[slot] != coded)
        at = _find(self.keys, coded[slow])
        out[slow] = np.where(at >= 0, self.known[at] if len(self.known) else np.nan, np.nan)
        return out


def _slot(coded: np.ndarray, bits: int) -> np.ndarray:
    return ((coded * _MULTIPLIER) >> _U(64 - bits)).astype(np.int64)


def _winners(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys that take a slot, their slots): of keys with one slot the most frequent."""
    first = np.argsort(-counts, kind="stable")
    slot = _slot(keys[first], bits)
    _, winner = np.unique(slot, return_index=True)
    return first[winner], slot[winner]


def _summed(nodes: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a level and their counts from those of a deeper one."""
    keys, inverse = np.unique(nodes & _U((1 << 8 * (level + 1)) - 1), return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)) if len(keys) else np.zeros(0)


def _completed(keys: np.ndarray, values: np.ndarray, whole: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a level with those of the contexts in ``whole`` in place of their own."""
    own = ~np.isin(keys >> _U(8), whole >> _U(8))
    keys, values = np.concatenate([keys[own], whole]), np.concatenate([values[own], sums])
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.concatenate(keys) if keys else np.zeros(0, _U)
    weights = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    unique, inverse = np.unique(joined, return_inverse=True)
    return unique, np.bincount(inverse, weights, len(unique)).astype(np.int64) if len(unique) else np.zeros(0, np.int64)


#: Distinct keys that a task holds before it sends them on.
HELD = 1 << 20
COUNTS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def corpus_counts(rows: DataFrame, config: LmConfig) -> DataFrame:
    """(kind, key, n) over all rows: kind 0 counts trie nodes, 1 words (hashed), 2 texts."""

    def emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=COUNTS.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: ([], []), 1: ([], [])}
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            data, offsets = text.buffers(batch.column(0))
            for a, b in text.groups(offsets):
                own, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for kind, values in ((0, grams(text.LOWER[own], cut, config.order)[0]), (1, text.Words(own, cut).hashes)):
                    keys, counts = np.unique(values, return_counts=True)
                    held[kind][0].append(keys)
                    held[kind][1].append(counts)
                    if sum(map(len, held[kind][0])) > 4 * HELD:
                        keys, counts = _tally(*held[kind])
                        if len(keys) > HELD:
                            yield emit(kind, keys, counts)
                            keys, counts = keys[:0], counts[:0]
                        held[kind] = ([keys], [counts])
        for kind in held:
            yield emit(kind, *_tally(*held[kind]))
        yield emit(2, np.zeros(1, _U), np.array([texts], np.int64))

    return rows.select("text").mapInArrow(scan, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", "n").toArrow()
    keys = table.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order].astype(np.int64)


def _least(nodes: DataFrame, bound: int) -> int:
    """The least count at which the nodes with as many or more are ``bound`` at most."""
    least, kept = np.iinfo(np.int64).max, 0
    # One row per distinct count, most frequent first, until the bound is reached.
    for r in nodes.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        kept += r["rows"]
        if kept > bound:
            break
        least = r["n"]
    return int(least)


def build_trie(counts: DataFrame, config: LmConfig) -> Trie:
    """The trie of the most frequent nodes; of nodes equally frequent all stay or none."""
    nodes = counts.where("kind = 0")
    least = _least(nodes, config.max_nodes) if nodes.count() > config.max_nodes else 1
    return Trie(*_arrays(nodes.where(F.col("n") >= least)), config)


def frequent_prices(nodes: DataFrame, config: LmConfig) -> Prices:
    """Prices of at most ``max_nodes`` nodes, with the totals and kinds of all nodes."""
    above = F.shiftrightunsigned("key", 8).alias("context")
    contexts = nodes.groupBy(above).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    top = nodes.where(F.col("n") >= _least(nodes, config.max_nodes)).select("key", "n", above).join(contexts, "context")
    got = top.select("key", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("price")).toArrow()  # max_nodes
    return Prices(got.column("key").to_numpy().view(_U), got.column("n").to_numpy(), got.column("price").to_numpy(), config)


def score_texts(docs: DataFrame, config: LmConfig = LmConfig(), id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The held-out fold teaches nothing. ``score`` is the trie's log10 probability of the
    text (A-Z lower-cased) with its end, ``base_score`` that of the add-one unigram model
    of words. A null text is empty: its only token is its end. Rows that repeat an id are
    scored one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = common.documents(docs, id_col, text_col)
    path = common.shared_dir(spark)
    counts = common.store(corpus_counts(rows.where(common.fold("id", folds) != held), config), f"{path}/counts")
    words = counts.where("kind = 1")
    stats = counts.where("kind > 0").agg(F.sum("n").alias("n"), F.count(F.when(F.col("kind") == 1, 1)).alias("v"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).first()
    ends = stats["ends"] or 0
    # Tokens in training, the ends included, and the distinct ones among them.
    total, distinct = stats["n"] or 0, (stats["v"] or 0) + (ends > 0)
    nodes = counts.where("kind = 0")
    size = nodes.count()
    complete = stats["v"] <= config.max_words
    frequent = words if complete else words.where(F.col("n") >= _least(words, config.max_words))
    table = spark.sparkContext.broadcast(_arrays(frequent))  # max_words
    if size > config.max_nodes or not complete:
        return _finished(_spread(rows, nodes, size, words, table, complete, total, distinct, ends, config), folds, held, total)
    trie = spark.sparkContext.broadcast(build_trie(counts, config))  # max_nodes
    return _finished(_scored(rows, trie, table, total, distinct, ends), folds, held, total)


SCORED = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _scored(rows: DataFrame, trie, table, total: int, distinct: int, ends: int) -> DataFrame:
    """Nodes and word counts from broadcast tables."""
    base = float(total + distinct + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie.value
        keys, counts = table.value
        for batch in batches:
            data, offsets = text.buffers(batch.column(1))
            for a, b in text.groups(offsets):
                own, cut, n = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
                coded, owner = grams(text.LOWER[own], cut, model.config.order)
                score = np.bincount(owner, model.price(coded), n)
                words = text.Words(own, cut)
                at = _find(keys, words.hashes)
                c = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
                row = words.rows()
                known = np.bincount(row, c > 0, n).astype(np.int64) + (ends > 0)
                logs = np.bincount(row, np.log10((c + 1) / base), n) + np.log10((ends + 1) / base)
                yield pa.record_batch([pa.nulls(n, pa.int64()), batch.column(0).slice(a, n), pa.array(words.counts() + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(score, pa.float64())], names=SCORED.names)

    return rows.select("id", "text").mapInArrow(scan, SCORED)


#: What a text adds to its score: its own row (kind 2), words (1) and grams (0) to be joined.
ENTRIES = T.StructType([T.StructField("kind", T.IntegerType()), *SCORED.fields, T.StructField("key", T.LongType())])


def _spread(rows: DataFrame, nodes: DataFrame, size: int, words: DataFrame, table, complete: bool, total: int, distinct: int, ends: int, config: LmConfig) -> DataFrame:
    """The same for any number of nodes and words; ``complete``: ``table`` has all words, none is joined."""
    spark = rows.sparkSession
    base = float(total + distinct + 1)
    shared = spark.sparkContext.broadcast(frequent_prices(nodes, config))  # max_nodes

    def joined(kind: int, row: pa.Array, key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        """Entries of the distinct (owner, key) pairs; ``n_tokens`` is how often each occurs."""
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))) if len(key) else np.zeros(0, np.int64)
        n, times = len(first), np.diff(np.append(first, len(key)))
        zero = pa.array(np.zeros(n))
        return pa.record_batch([pa.array(np.full(n, kind), pa.int32()), row.take(pa.array(owner[first])), pa.nulls(n, pa.int64()), pa.array(times, pa.int64()), pa.array(np.zeros(n, np.int64)), zero, zero, pa.array(key[first].view(np.int64))], names=ENTRIES.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices = shared.value
        keys, counts = table.value
        for batch in batches:
            data, offsets = text.buffers(batch.column(2))
            for a, b in text.groups(offsets):
                own, cut, n = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
                number = batch.column(0).slice(a, n)
                coded, owner = grams(text.LOWER[own], cut, config.order)
                price = prices.price(coded)
                rare = np.isnan(price)
                score = np.bincount(owner, np.where(rare, 0.0, price), n)
                found = text.Words(own, cut)
                at, row = _find(keys, found.hashes), found.rows()
                here = np.ones(len(at), bool) if complete else at >= 0
                if not complete:
                    yield joined(1, number, found.hashes[~here], row[~here])
                c = np.where(at >= 0, counts[at] if len(counts) else 0, 0)[here]
                row = row[here]
                tokens = np.bincount(row, minlength=n) + 1
                known = np.bincount(row, c > 0, n).astype(np.int64) + (ends > 0)
                logs = np.bincount(row, np.log10((c + 1) / base), n) + np.log10((ends + 1) / base)
                yield joined(0, number, coded[rare], owner[rare])
                yield pa.record_batch([pa.array(np.full(n, 2), pa.int32()), number, batch.column(1).slice(a, n), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(score, pa.float64()), pa.nulls(n, pa.int64())], names=ENTRIES.names)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    entries = common.store(numbered.mapInArrow(scan, ENTRIES), f"{common.shared_dir(spark)}/entries")
    parts = entries.where("kind = 2").select(SCORED.names)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    if not complete:
        listed = entries.where("kind = 1").select("row", "key", "n_tokens").join(words.select("key", F.col("n").alias("c")), "key", "left")
        logs = F.col("n_tokens") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(base))
        parts = parts.union(listed.select("row", none, "n_tokens", F.when(F.col("c") > 0, F.col("n_tokens")).otherwise(zero), logs, F.lit(0.0)))
    priced = _priced(entries.where("kind = 0").select("row", "key", F.col("n_tokens").alias("n")), nodes, size, config)
    parts = parts.union(priced.select("row", none, zero, zero, F.lit(0.0), "score"))
    return parts.groupBy("row").agg(F.max("id").alias("id"), *(F.sum(c).alias(c) for c in SCORED.names[2:]))


def _priced(grams: DataFrame, nodes: DataFrame, size: int, config: LmConfig) -> DataFrame:
    """(row, score) of (row, key, n) grams. A task has all nodes of its contexts of two bytes, or of
    three where these have more than ``max_cell``, and, broadcast, the nodes of the levels below."""
    spark = grams.sparkSession
    whole = min(2, config.order)
    lowest = nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * whole) - 1)).alias("key")).agg(F.sum("n").alias("n"))
    keys, counts = _arrays(lowest)  # 65,536 nodes at most
    cell = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * whole) - 1))
    hot: list[int] = []
    split = None
    if config.order > whole:
        # size / max_cell pairs of bytes at most, with 256 sums each.
        hot = [r["cell"] for r in nodes.groupBy(cell.alias("cell")).count().where(F.col("count") > config.max_cell).collect()]
    if hot:
        next_level = F.col("key").bitwiseAND(F.lit((1 << 8 * (whole + 1)) - 1))
        split = _arrays(nodes.where(cell.isin(hot)).groupBy(next_level.alias("key")).agg(F.sum("n").alias("n")))
    shared = spark.sparkContext.broadcast(([_summed(keys, counts, k) for k in range(whole)], split))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trie = ([], []), None
        for batch in batches:
            row, key, n = (c.to_numpy() for c in batch.columns)
            at = int(np.searchsorted(row, 0))  # nodes are first, as row -1
            if at:
                own[0].append(key[:at].view(_U))
                own[1].append(n[:at])
            if at == len(row):
                continue
            if trie is None:
                trie = Trie(*_tally(*own), config, *shared.value)
            key, inverse = np.unique(key[at:].view(_U), return_inverse=True)
            rows, place = np.unique(row[at:], return_inverse=True)
            score = np.bincount(place, n[at:] * trie.walk(key)[inverse], len(rows))
            yield pa.record_batch([pa.array(rows), pa.array(score)], names=schema.names)

    both = nodes.select(F.lit(-1).cast("long").alias("row"), "key", "n").union(grams)
    longer = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * (whole + 1)) - 1))
    third = F.when(cell.isin(hot), longer).otherwise(-1) if hot else F.lit(-1)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // HELD))
    return both.repartition(number, cell, third).sortWithinPartitions("row").mapInArrow(scan, schema).groupBy("row").agg(F.sum("score").alias("score"))


def _finished(scored: DataFrame, folds: int, held: int, total: int) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), (common.fold("id", folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
