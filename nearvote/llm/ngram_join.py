"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

Every document is the set of its distinct k-word shingles. Two documents link when
``100 * intersection >= percent * union``, so a linked document must occur in at
least T of a query's inverted lists. DivideSkip splits those lists: the short ones
are merged to find documents that may reach T, the long ones are only probed.

Distributed form:

1. ``profile``: one pass takes each set's size and 128-bit digest and adds up a
   fixed-size count sketch of shingle frequencies over all documents. Documents with
   equal sets become one class; only its least id goes on.
2. ``postings``: with the sketch every shingle gets a rank, rare before frequent.
   A document posts only to its n - T + 1 rarest shingles: any linked pair meets in one
   of these short lists, and the T - 1 long lists set aside are never written anywhere.
3. ``inverted``: the postings go by token to cells of bounded size, as packed arrays. A
   list of one member, nine of ten postings, ends there. A token that the sketch calls
   frequent is spread over as many cells as its frequency asks for.
4. ``star round``: in each list each member is paired with the list's least member and, in a
   longer list, with the one in the middle and the two where the list's token comes first, its pivots
   (with several cells: the cell's; their least members with the least of all). The last two have
   the fewest rarer shingles, so they link where two members edited much do not.
5. ``rest round``: lists whose members all lie in one component are done. In the others
   the members outside the largest component are searched against all members; so a
   large group of near copies costs its size and not its square.
6. ``linking``: pairs of either round that sizes, list positions, the parity sketch (a lower
   bound of the symmetric difference) or the merged count of their short lists rule out
   are dropped. For the others, a query document and a bounded chunk of its candidates at
   a time, inverted lists are built, the short ones heap-merged, the long ones probed by
   binary search (``divide_skip``), and the exact condition decides.

Hashes have 64 bits; a shingle's rank keeps 56 of them. Nothing is sampled or capped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.llm import common, text

_U = np.uint64
#: Cells of one row of the count sketch, its rows, and the blocks it is shipped in.
SKETCH_CELLS, SKETCH_ROWS, SKETCH_BLOCKS = 1 << 18, 2, 32
#: Bits of the parity sketch.
PARITY = 512
#: Most bits of the filter that says whose sets a verification needs.
FILTER_BITS = 1 << 25
#: Candidates that one verification group indexes at a time.
CHUNK = 64
#: Postings of a cell, about.
CELL = 1 << 18
#: Pivots of a list of at least twice as many members, half of them by id and half by position; a
#: shorter list has one.
PIVOTS = 4
#: Bits of a rank below the frequency class.
RANK_BITS = 56


@dataclass(frozen=True)
class JoinConfig:
    """``k`` words a shingle; a link needs 100 * intersection >= percent * union."""

    k: int = 4
    percent: int = 85

    def required(self, n: int | np.ndarray) -> int | np.ndarray:
        """Least overlap of a set of ``n`` with any set it links to: ceil(n * percent / 100)."""
        return (n * self.percent + 99) // 100


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Indexes of the sets that link with ``query``; all arrays sorted and distinct.

    Inverted lists over ``sets`` are built for the query's elements. With T the least
    overlap any of the sets needs, the L longest lists are set aside; a set that reaches
    T must occur at least T - L times in the others, which a heap merges in order of set
    index, jumping over sets that cannot get there. Survivors are probed in the long lists.
    """
    n = len(query)
    if not n or not sets:
        return []
    sizes = [len(s) for s in sets]
    lists: dict[int, list[int]] = {}
    for j, s in enumerate(sets):
        if not s.size or 100 * min(n, sizes[j]) < percent * max(n, sizes[j]):
            continue
        at = np.searchsorted(query, s)
        at[at == n] = 0
        for q in at[query[at] == s].tolist():
            lists.setdefault(q, []).append(j)
    need = [-(-percent * (n + m) // (100 + percent)) for m in sizes]
    least = min((need[j] for lst in lists.values() for j in lst), default=1)
    ordered = sorted(lists.values(), key=len)
    longest = len(ordered[-1]) if ordered else 0
    aside = min(len(ordered), max(0, int(least / (1 + 0.1 * np.log2(1 + longest))) - 1), least - 1)
    short, long = ordered[: len(ordered) - aside], ordered[len(ordered) - aside :]
    wanted = least - aside
    heap = [(lst[0], i, 0) for i, lst in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while heap:
        doc, popped = heap[0][0], []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= wanted:
            total = len(popped)
            for seen, lst in enumerate(long):
                if total + len(long) - seen < need[doc]:
                    break
                p = bisect_left(lst, doc)
                total += p < len(lst) and lst[p] == doc
            if total >= need[doc] and 100 * total >= percent * (n + sizes[doc] - total):
                found.append(doc)
            skip_to = doc + 1
        else:  # no document before the head of the (wanted - 1)th next list can occur often enough
            while heap and len(popped) < wanted - 1:
                popped.append(heapq.heappop(heap))
            skip_to = max(doc + 1, heap[0][0]) if heap else doc + 1
            if not heap:
                break
        for _, i, p in popped:
            p = bisect_left(short[i], skip_to, p)
            if p < len(short[i]):
                heapq.heappush(heap, (short[i][p], i, p))
    return found


def _cells(shingles: np.ndarray) -> list[np.ndarray]:
    return [((shingles >> _U(shift)) % _U(SKETCH_CELLS)).astype(np.int64) for shift in (40, 10)]


def profile(docs: DataFrame, config: JoinConfig, path: str) -> tuple[DataFrame, np.ndarray]:
    """(id, n, digest) of every row, and the frequency class of each sketch cell (uint8)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    k = config.k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((SKETCH_ROWS, SKETCH_CELLS), np.uint32)
        for batch in batches:
            sizes, digests = [], []
            for _, _, words in text.iterate(batch.column(1)):
                group = list(text.shingle_sets(words, k))
                for s in group:
                    sizes.append(len(s))
                    digests.append(_digest(s))
                if group and (joined := np.concatenate(group)).size:
                    for row, at in zip(cells, _cells(joined)):
                        row += np.bincount(at, minlength=SKETCH_CELLS).astype(np.uint32)
            none = [None] * len(sizes)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=arrow)
        if cells.any():
            parts = cells.reshape(SKETCH_BLOCKS, -1)
            none = [None] * SKETCH_BLOCKS
            yield pa.record_batch([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=arrow)

    both = common.store(docs.select("id", "text").mapInArrow(scan, schema), path)
    parts = both.where("block is not null")
    wide = parts.select("block", F.col("counts").alias("payload"))
    sums = common.add_up(wide, "block", "payload", "<u4", "add", 16)
    counts = np.zeros((SKETCH_BLOCKS, SKETCH_CELLS * SKETCH_ROWS // SKETCH_BLOCKS), np.float64)
    for block, vector in sums.items():
        counts[block] = vector
    counts = counts.reshape(SKETCH_ROWS, SKETCH_CELLS)
    # What rises above the noise of the many rare shingles in a cell counts as frequency.
    middle = np.median(counts, axis=1, keepdims=True)
    classes = np.floor(np.log2(np.maximum(1, (counts - middle) / (6 * np.sqrt(middle) + 4)))).astype(np.uint8)
    return both.where("block is null").select("id", "n", "digest"), classes


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a sorted set: two independent position-dependent sums."""
    if not s.size:
        return b""
    at = np.arange(1, len(s) + 1, dtype=_U)
    a = text.mix(s ^ (at * _U(0x9FB21C651E98DF25))).sum(dtype=_U)
    b = text.mix(s + at * _U(0xA24BAED4963EE407)).sum(dtype=_U)
    return a.tobytes() + b.tobytes()


def ranks(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rank of each shingle in the global order (rare first), distinct up to 56 bits."""
    low = np.minimum(*(row[at] for row, at in zip(classes, _cells(s)))).astype(np.int64)
    return (low << RANK_BITS) | (s >> _U(64 - RANK_BITS)).astype(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity sketch: bit b is the parity of the elements that fall on b."""
    bits = (np.bincount((s % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(bits).view("<i8")


def postings(docs: DataFrame, config: JoinConfig, classes: np.ndarray) -> DataFrame:
    """(id, n, parity, prefix): each document's n - T + 1 rarest shingles, in rank order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)  # SKETCH_ROWS * SKETCH_CELLS bytes, whatever the corpus
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids, row = batch.column(0), 0
            for _, end, words in text.iterate(batch.column(1)):
                keep, sizes, bits, prefixes = [], [], [], []
                for s in text.shingle_sets(words, config.k):
                    if (n := len(s)) and ids[row].is_valid:
                        keep.append(row)
                        sizes.append(n)
                        bits.append(parity(s))
                        prefixes.append(np.sort(ranks(s, table))[: n - config.required(n) + 1])
                    row += 1
                lengths = np.cumsum([0, *map(len, prefixes)])
                yield pa.record_batch([ids.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * (PARITY // 64), pa.int32()), pa.array(np.concatenate(bits) if bits else [], pa.int64())), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))], names=["id", "n", "parity", "prefix"])
                assert row == end

    return docs.select("id", "text").mapInArrow(scan, schema)


def inverted(entries: DataFrame, config: JoinConfig) -> DataFrame:
    """(token, id, n, pos, head, pivots) of the inverted lists that may have several members.

    ``head`` marks the least member of a list's part in a cell. ``pivots`` has the ids of the
    part's pivots, null for those with which sizes and positions do not let the member link. A
    task holds one cell, about ``CELL`` postings.
    """
    total = entries.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    cells = max(1, -(-int(total) // CELL))
    kinds = (("token", "<i8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4"))
    packed = T.StructType([T.StructField("cell", T.LongType()), *(T.StructField(c, T.BinaryType()) for c, _ in kinds)])
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("head", T.BooleanType()), T.StructField("pivots", T.ArrayType(T.LongType()))])
    percent = config.percent

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        token, owner = columns[0].view(_U), columns[1].view(_U)
        spread = _U(1) << (token >> _U(RANK_BITS))
        cell = ((text.mix(token) + text.mix(owner) % spread) % _U(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        own, first = np.unique(cell[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        columns = [c[order].astype(kind) for c, (_, kind) in zip(columns, kinds)]
        return pa.record_batch([pa.array(own), *(pa.array([c[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()) for c in columns)], names=packed.names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ids, n = (np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 1))
            held.append((batch.column(2).flatten().to_numpy(), ids, n, pos))
            size += len(pos)
            if size > CELL:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    def group(table: pa.Table) -> pa.Table:
        token, ids, n, pos = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds)
        order = np.lexsort((ids, token))
        token, ids, n, pos = token[order], ids[order], n[order], pos[order]
        # Each list by position: its first members have the fewest rarer shingles, so they are nearest to the others.
        central = np.lexsort((ids, pos, token))
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(start, len(token)))
        # A frequent token has members in other cells.
        keep = np.repeat((size > 1) | (token[start] >> RANK_BITS > 0), size)
        top = np.repeat(start, size)[keep]
        token, own, m, at = token[keep], ids[keep], n[keep].astype(np.int64), pos[keep]
        step = np.repeat(np.where(size >= 2 * PIVOTS, size, 0), size)[keep]
        found, useless = [], []
        for pivot in range(PIVOTS):
            place = top + step * 2 * pivot // PIVOTS if 2 * pivot < PIVOTS else central[top + np.where(step > 0, pivot - PIVOTS // 2, 0)]
            other, k = ids[place], n[place].astype(np.int64)
            overlap = np.minimum(m - at, k - pos[place])
            found.append(other)
            useless.append((own == other) | (100 * np.minimum(m, k) < percent * np.maximum(m, k)) | (100 * overlap < percent * (m + k - overlap)) | ((pivot > 0) & (step == 0)))
        pivots = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * PIVOTS, pa.int32()), pa.array(np.stack(found, axis=1).ravel(), mask=np.stack(useless, axis=1).ravel()))
        return pa.table({"token": token, "id": own, "n": pa.array(m, pa.int32()), "pos": pa.array(at, pa.int32()), "head": np.flatnonzero(keep) == top, "pivots": pivots})

    return entries.select("id", "n", "prefix").mapInArrow(deal, packed).groupBy("cell").applyInArrow(group, schema)


def _bound(a: str, b: str):
    """Most overlap of a pair whose first common shingle is this list's."""
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))


def _enough(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _sized(a: str, b: str, percent: int):
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _allowed(a: str, b: str, percent: int):
    """Whether sizes and the places of their common shingle let a pair link."""
    return _sized(a, b, percent) & _enough(_bound(a, b), F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def _near(pa_, pb, na, nb, percent: int):
    """Whether two parity sketches leave the sets near enough."""
    apart = sum((F.bit_count(pa_[i].bitwiseXOR(pb[i])) for i in range(PARITY // 64)), F.lit(0))
    # |A xor B| = na + nb - 2 o, and o >= percent / (100 + percent) * (na + nb)
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _parity_allows(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose parity sketches do not put their sets too far apart."""
    a = entries.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("parity").alias("pu"))
    b = entries.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("parity").alias("pv"))
    near = _near(F.col("pu"), F.col("pv"), F.col("nu"), F.col("nv"), percent)
    return pairs.join(a, "u").join(b, "v").where(near).select("u", "v").distinct()


def _prefix_allows(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose prefixes share enough: beyond the earlier-ending prefix no more
    shingles can be common than its document has left."""

    def side(x: str) -> DataFrame:
        return entries.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))

    def after(x: str):
        return F.col(f"n{x}") - F.size(f"p{x}")

    last_u, last_v = F.element_at("pu", -1), F.element_at("pv", -1)
    room = F.when(last_u < last_v, after("u")).when(last_u > last_v, after("v")).otherwise(F.least(after("u"), after("v")))
    common = F.size(F.array_intersect("pu", "pv"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    return joined.where(_enough(common + room, F.col("nu"), F.col("nv"), percent)).select("u", "v").distinct()


def linking(docs: DataFrame, pairs: DataFrame, entries: DataFrame, config: JoinConfig, path: str) -> DataFrame:
    """Those of the pairs (u, v), in which a pair may repeat, that link."""
    near = common.store(_parity_allows(pairs.distinct(), entries, config.percent), f"{path}/near")
    return common.store(verify(docs, _prefix_allows(near, entries, config.percent), config, path), f"{path}/links")


def verify(docs: DataFrame, pairs: DataFrame, config: JoinConfig, path: str) -> DataFrame:
    """Those of the pairs (u, v) that link, by ``divide_skip`` of u against chunks of its v."""
    spark = docs.sparkSession
    pairs = common.store(pairs.select("u", "v"), f"{path}/pairs")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    count = pairs.count()
    if not count:
        return spark.createDataFrame([], schema)
    fan = pairs.groupBy("u").agg(F.count("*").alias("fan"))
    chunked = common.store(pairs.join(fan, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("fan") / CHUNK)).alias("chunk")), f"{path}/chunks")  # read four times
    rows = chunked.select("u", "chunk", F.col("v").alias("id")).union(chunked.select("u", "chunk", F.col("u").alias("id")).distinct())
    sets = _needed_sets(docs, rows.select("id").distinct(), config, min(FILTER_BITS, max(1 << 16, 1 << (64 * count).bit_length())))
    percent = config.percent

    def check(table: pa.Table) -> pa.Table:
        u = table.column("u")[0].as_py()
        ids, raw = table.column("id").to_pylist(), table.column("shingles").to_pylist()
        sets = [np.frombuffer(x, _U) for x in raw]
        own = [s for i, s in zip(ids, sets) if i == u]
        others = [(i, s) for i, s in zip(ids, sets) if i != u]
        hit = sorted({others[j][0] for query in own for j in divide_skip(query, [s for _, s in others], percent)})
        return pa.table({"u": pa.array([u] * len(hit), pa.int64()), "v": pa.array(hit, pa.int64())})

    return rows.join(sets, "id").groupBy("u", "chunk").applyInArrow(check, schema)


def _needed_sets(docs: DataFrame, ids: DataFrame, config: JoinConfig, size: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (and a few others, which joins drop).

    A filter of ``size`` bits spares most documents the way through a shuffle.
    """
    spark = docs.sparkSession
    block_bits = 1 << 16
    flagged = ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("bit"))
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False)] = True
        rows = bits.reshape(-1, block_bits)
        own = np.flatnonzero(rows.any(axis=1))
        yield pa.record_batch([pa.array(own, pa.int32()), pa.array([np.packbits(rows[i]).tobytes() for i in own], pa.binary())], names=["block", "payload"])

    merged = common.add_up(flagged.mapInArrow(bitmaps, schema), "block", "payload", "u1", "or", 16)
    packed = np.zeros((size // block_bits, block_bits // 8), np.uint8)
    for block, vector in merged.items():
        packed[block] = vector
    shared = spark.sparkContext.broadcast(packed.reshape(-1))  # size / 8 bytes
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            want = (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
            kept = batch.filter(pa.array(want.astype(bool)))
            row = 0
            for _, end, words in text.iterate(kept.column(1)):
                raw = [s.tobytes() for s in text.shingle_sets(words, config.k)]
                yield pa.record_batch([kept.column(0).slice(row, end - row), pa.array(raw, pa.binary())], names=["id", "shingles"])
                row = end

    return docs.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("bit")).mapInArrow(scan, out)


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the least id reachable by links, the row's own included. Null and
    blank texts have the empty set and link with nothing; rows with equal sets link; rows
    that repeat an id are one vertex. A null id keeps its row: its component is the least
    id of the rows with the same set that have one, else null. An empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    config = JoinConfig(k, percent)
    path = common.shared_dir(spark)
    rows = common.documents(docs, id_col, text_col)
    profiles, classes = profile(rows, config, f"{path}/profile")
    filled = profiles.where("n > 0")
    classes_of = filled.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # Prefixes of all rows are cheaper than sending texts through a shuffle to find the representatives.
    reps = classes_of.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    entries = common.store(postings(rows, config, classes).join(reps, "id", "left_semi"), f"{path}/entries")
    lists = common.store(inverted(entries, config), f"{path}/lists")

    pairs = lists.select("id", F.explode("pivots").alias("pivot")).where("pivot is not null").select(F.least("pivot", "id").alias("u"), F.greatest("pivot", "id").alias("v"))
    heads = lists.where(F.col("head") & (F.col("token") >= 1 << RANK_BITS)).select("token", F.struct("id", "n", "pos").alias("b"))
    least = heads.groupBy("token").agg(F.min("b").alias("a"))
    parts = heads.join(least, "token").where((F.col("a.id") != F.col("b.id")) & _allowed("a", "b", percent))
    star_links = linking(rows, pairs.union(parts.select("a.id", "b.id")), entries, config, f"{path}/star")
    first = common.components(spark, star_links, f"{path}/cc1")

    named = lists.select("token", "id", "n", "pos").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", F.negative("component").alias("minus"))).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("members")).where("parts > 1").select("token", "members", F.negative("top.minus").alias("main"))
    sketches = entries.select("id", F.col("n").cast("int").alias("n"), "parity")
    open_lists = common.store(named.join(largest, "token").join(sketches, ["id", "n"]), f"{path}/open")
    cells = F.ceil(F.col("members") / 4096)
    apart = open_lists.where("component <> main").withColumn("cell", F.explode(F.sequence(F.lit(0), (cells - 1).cast("int")))).alias("a")
    whole = open_lists.withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("int")).alias("b")
    rest = apart.join(whole, (F.col("a.token") == F.col("b.token")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))) & _allowed("a", "b", percent) & _near(F.col("a.parity"), F.col("b.parity"), F.col("a.n"), F.col("b.n"), percent))
    rest_links = linking(rows, rest.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")), entries, config, f"{path}/rest")
    # Rows that repeat an id are one vertex: what their classes reach belongs together.
    several = filled.where("id is not null").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    owned = filled.join(several, "id").select("id", "digest").join(classes_of, "digest").select("id", "rep")
    same_id = owned.join(owned.groupBy("id").agg(F.min("rep").alias("u")), "id").select("u", F.col("rep").alias("v")).where("u <> v")
    linked = common.components(spark, star_links.union(rest_links).union(same_id), f"{path}/cc2")

    rep_of = common.store(classes_of.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("shared")), f"{path}/classes")
    common.remove(spark, *(f"{path}/{x}" for x in ("entries", "lists", "open", "star", "rest", "cc1", "cc2")))
    # Popular texts: a thousandth of all rows each or more, so a thousand at most.
    popular = F.broadcast(rep_of.where(F.col("copies") * 1000 >= filled.count()).select("digest", F.col("shared").alias("known")))
    marked = filled.join(popular, "digest", "left")
    out = marked.where("known is null").select("id", "n", "digest").join(rep_of, "digest").select("id", "n", "shared")
    out = out.union(marked.where("known is not null").select("id", "n", "known")).union(profiles.where("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("shared", "id").alias("component_id"))
