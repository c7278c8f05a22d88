"""Exact neighbours among many references of few dimensions, by the cells of a k-d tree.

The tree is fitted on a bounded sample; every reference is dealt to a cell by it. Queries visit the
cells around them first, whose k-th distance then bounds the others: a cell is visited again only
where its box may hold something as near. So the result is exact, whatever the sample. ``LocalCells``
holds references that fit a broadcast and searches them within a task; ``nearest`` shuffles
(query, cell) pairs to packed lists of members, in groups bounded on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.operators import knn, knn_kernel, routed
from nearvote.sources.scratch import stored

#: Members of a cell, rows of the sample that the tree is fitted on, queries of a group.
MEMBERS, SAMPLE, QUERIES = 2048, 1 << 17, 4096
#: Members of a cell that is searched within a task.
LOCAL_MEMBERS = 512
#: Pairs from which on cells are worth their shuffles, and most dimensions in which boxes prune.
FROM_PAIRS, MOST_DIMS = 1 << 31, 16


@dataclass(frozen=True)
class Tree:
    """A perfect binary tree in heap order: what each inner node asks, and each node's box and members."""

    depth: int
    dim: np.ndarray
    cut: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    count: np.ndarray | None = None

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def leaf(self, v: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(v), np.int64), np.arange(len(v))
        for _ in range(self.depth):
            at = 2 * at + 1 + (v[row, self.dim[at]] > self.cut[at])
        return at - self.inner

    def boxed(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Tree:
        """The tree with the boxes and counts of the given leaves, and of all that is above them."""
        nodes, dims = 2 * self.inner + 1, low.shape[1]
        lows, highs, counts = np.full((nodes, dims), np.inf), np.full((nodes, dims), -np.inf), np.zeros(nodes, np.int64)
        lows[leaf + self.inner], highs[leaf + self.inner], counts[leaf + self.inner] = low, high, count
        for level in range(self.depth - 1, -1, -1):
            at = np.arange((1 << level) - 1, (2 << level) - 1)
            lows[at], highs[at] = np.minimum(lows[2 * at + 1], lows[2 * at + 2]), np.maximum(highs[2 * at + 1], highs[2 * at + 2])
            counts[at] = counts[2 * at + 1] + counts[2 * at + 2]
        return replace(self, low=lows, high=highs, count=counts)

    def around(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs: each query's own leaf, or the least subtree around it of more than k members."""
        node, up = self.leaf(q) + self.inner, np.zeros(len(q), np.int64)
        while (climb := np.flatnonzero((self.count[node] <= k) & (node > 0))).size:
            node[climb], up[climb] = (node[climb] - 1) // 2, up[climb] + 1
        width = 1 << up
        row = np.repeat(np.arange(len(q)), width)
        first = (node + 1) * width - 1 - self.inner
        leaf = np.repeat(first, width) + np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        held = self.count[leaf + self.inner] > 0
        return row[held], leaf[held]

    def within(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs whose box may hold something not farther than the query's bound."""
        row, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.depth + 1):
            if level:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
            row, node = (x[self.count[node] > 0] for x in (row, node))
            near = np.zeros(len(row), bool)
            for a in range(0, len(row), 1 << 15):
                r, n = row[a : a + (1 << 15)], node[a : a + (1 << 15)]
                gap = np.maximum(np.maximum(self.low[n] - q[r], q[r] - self.high[n]), 0)
                near[a : a + (1 << 15)] = (gap * gap).sum(axis=1) <= bound[r] * (1 + 1e-9)
            row, node = row[near], node[near]
        return row, node - self.inner


def fit(sample: np.ndarray, depth: int) -> Tree:
    """A tree that halves the sample along the widest dimension of each node."""
    inner = (1 << depth) - 1
    dim, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    rows = {0: np.arange(len(sample))}
    for node in range(inner):
        own = rows.pop(node)
        v = sample[own]
        right = np.zeros(len(own), bool)
        if len(own) > 1:
            dim[node] = at = int(v.var(axis=0).argmax())
            x = v[:, at]
            middle, most = np.partition(x, len(x) // 2)[len(x) // 2], x.max()
            if x.min() < most:
                cut[node] = middle if middle < most else x[x < most].max()
                right = x > cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return Tree(depth, dim, cut)


def _depth(n: int, members: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / members))))


class LocalCells:
    """References in the order of their cells, to be broadcast."""

    def __init__(self, rid: np.ndarray, r: np.ndarray, fraud: np.ndarray):
        usable = np.isfinite(r).all(axis=1)
        rid, r, fraud = rid[usable], r[usable], fraud[usable]
        tree = fit(r, _depth(len(r), LOCAL_MEMBERS))
        leaf = tree.leaf(r)
        order = np.argsort(leaf, kind="stable")
        self.rid, self.r, self.fraud = rid[order], r[order], fraud[order]
        self.starts = np.searchsorted(leaf[order], np.arange((1 << tree.depth) + 1))
        at = np.flatnonzero(np.diff(self.starts))
        boxes = [f.reduceat(self.r, self.starts[at], axis=0) if len(at) else np.zeros((0, r.shape[1])) for f in (np.minimum, np.maximum)]
        self.tree = tree.boxed(at, *boxes, np.diff(self.starts)[at])

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> knn_kernel.Best:
        best = knn_kernel.Best(qid, q, k, exclude_self)
        if not len(q) or not len(self.rid):
            return best
        row, leaf = self.tree.around(q, k)
        self._visit(best, row, leaf)
        seen = row * len(self.starts) + leaf
        row, leaf = self.tree.within(q, best.worst)
        new = ~np.isin(row * len(self.starts) + leaf, seen)
        self._visit(best, row[new], leaf[new])
        return best

    def _visit(self, best: knn_kernel.Best, row: np.ndarray, leaf: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        ends = np.flatnonzero(np.diff(leaf, append=-1)) + 1
        found = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            rows, part = row[a:b], slice(self.starts[leaf[a]], self.starts[leaf[a] + 1])
            at, to, d = knn_kernel.nearest_block(best.qid[rows], best.q[rows], self.rid[part], self.r[part], best.k, best.exclude_self, best.worst[rows])
            found.append((rows[at], self.rid[part][to], self.fraud[part][to], d))
        if found:
            best.merge(*(np.concatenate(x) for x in zip(*found)))


@dataclass(frozen=True)
class Cells:
    """Packed lists of all references by cell, and the tree that finds them."""

    tree: Tree
    lists: DataFrame
    parts: dict[int, int]
    dims: int


def build(references: DataFrame, dims: int) -> Cells:
    """Cells of (ref_id, fraud, vec); null and non-finite vectors take no part."""
    spark = references.sparkSession
    known = references.where("vec is not null and forall(vec, x -> x is not null and abs(x) < double('infinity'))").select("ref_id", "fraud", F.col("vec").cast("array<double>").alias("vec"))
    n = known.count()
    sample = known.select("vec") if n <= SAMPLE else known.select("vec").sample(SAMPLE / n, seed=42)
    rows = knn_kernel.matrix(sample.toArrow().column(0).combine_chunks(), dims)
    tree = fit(rows, min(_depth(n, MEMBERS), _depth(SAMPLE, 8)))
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf(knn_kernel.matrix(batch.column(2), dims)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(leaf)], names=["ref_id", "mark", "q", "cluster_id"])

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [x.values.to_numpy(zero_copy_only=False).reshape(-1, dims) for x in batch.column("q")]
            yield pa.record_batch([batch.column("cluster_id"), batch.column("part"), pa.array([len(v) for v in vecs], pa.int64()), *(pa.array([f(v, axis=0).tolist() for v in vecs], pa.list_(pa.float64())) for f in (np.min, np.max))], names=["cluster_id", "part", "n", "low", "high"])

    dealt = known.mapInArrow(deal, "ref_id long, mark int, q array<double>, cluster_id int")
    lists = stored(routed.inverted_lists(stored(dealt)))
    boxes = lists.select("cluster_id", "part", "q").mapInArrow(box, "cluster_id int, part int, n long, low array<double>, high array<double>")
    sides = [F.array(*(f(F.get(c, F.lit(i))) for i in range(dims))).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    known_cells = boxes.groupBy("cluster_id").agg(F.sum("n").alias("n"), (F.max("part") + 1).alias("parts"), *sides).toArrow().combine_chunks()  # a row a cell
    ids, counts, parts = (known_cells.column(c).to_numpy() for c in ("cluster_id", "n", "parts"))
    low, high = (knn_kernel.matrix(known_cells.column(c).combine_chunks(), dims) for c in ("low", "high"))
    return Cells(tree.boxed(ids, low, high, counts), lists, dict(zip(ids.tolist(), parts.tolist())), dims)


def nearest(queries: DataFrame, cells: Cells, k: int, exclude_self: bool = True) -> DataFrame:
    """(qid, ref_id, fraud, d, rk), as ``knn.nearest``, of (qid, qv) rows with unique ids."""
    asked = stored(queries.where("qv is not null").select("qid", F.col("qv").cast("array<double>").alias("qv")))
    first = stored(knn.ranked(_visit(asked.withColumn("bound", F.lit(None).cast("double")), cells, k, exclude_self), k))
    bounds = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    again = asked.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = _visit(stored(again), cells, k, exclude_self)
    return knn.ranked(first.drop("rk").unionByName(second), k)


def _visit(asked: DataFrame, cells: Cells, k: int, exclude_self: bool) -> DataFrame:
    """(qid, ref_id, fraud, d) of the cells around each query; where it has a bound, of the other ones within it."""
    spark, dims, blocks = asked.sparkSession, cells.dims, routed.RoutedConfig().cell_blocks
    shared = spark.sparkContext.broadcast(cells.tree)
    leaves = 1 << cells.tree.depth
    pieces = np.ones(leaves, np.int64)
    for leaf, parts in cells.parts.items():
        pieces[leaf] = -(-parts // blocks)

    def wanted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        q, bound = knn_kernel.matrix(batch.column("qv"), dims), batch.column("bound")
        for a in range(0, len(q), 1024):
            part = slice(a, a + 1024)
            row, leaf = shared.value.around(q[part], k)
            if not bound.null_count:
                seen = row * leaves + leaf
                row, leaf = shared.value.within(q[part], bound.to_numpy(zero_copy_only=False)[part])
                new = ~np.isin(row * leaves + leaf, seen)
                row, leaf = row[new], leaf[new]
            yield row + a, leaf

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(leaves, np.int64)
        for batch in batches:
            for _, leaf in wanted(batch):
                pairs += np.bincount(leaf, minlength=leaves)
        at = np.flatnonzero(pairs)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(pairs[at])], names=["cluster_id", "n"])

    counted = {r[0]: r[1] for r in asked.select("qv", "bound").mapInArrow(count, "cluster_id int, n long").groupBy("cluster_id").agg(F.sum("n")).collect()}  # a row a cell
    chunks = {leaf: -(-n // QUERIES) for leaf, n in counted.items()}
    n_chunks = np.ones(leaves, np.int64)
    for leaf, n in chunks.items():
        n_chunks[leaf] = n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qid = batch.column("qid").to_numpy(zero_copy_only=False)
            spread = ((qid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for row, leaf in wanted(batch):
                copies = pieces[leaf]
                row, leaf = np.repeat(row, copies), np.repeat(leaf, copies)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                for a in range(0, len(row), QUERIES):  # small batches: each row carries a vector
                    r, c = row[a : a + QUERIES], leaf[a : a + QUERIES]
                    at = pa.array(r)
                    yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(cell[a : a + QUERIES].astype(np.int32)), pa.array((spread[r] % n_chunks[c]).astype(np.int32)), *(batch.column(x).take(at) for x in ("qid", "qv", "bound"))], names=["cluster_id", "cell", "chunk", "qid", "qv", "bound"])

    def scan(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        best = knn_kernel.Best(pairs.column("qid").to_numpy(), knn_kernel.matrix(pairs.column("qv").combine_chunks(), dims), k, exclude_self)
        best.worst = pairs.column("bound").fill_null(float("inf")).to_numpy().copy()
        rid, fraud, r = (lists.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "marks", "q"))
        best.add(rid, fraud, r.reshape(-1, dims))
        return pa.Table.from_batches(best.batches(), knn_kernel.ARROW)

    pairs = asked.mapInArrow(route, "cluster_id int, cell int, chunk int, qid long, qv array<double>, bound double")
    copies = spark.createDataFrame(sorted(chunks.items()), "cluster_id int, chunks int")  # a row a cell
    held = cells.lists.join(F.broadcast(copies), "cluster_id").select("cluster_id", F.floor(F.col("part") / blocks).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "ids", "marks", "q")
    key = ["cluster_id", "cell", "chunk"]
    return pairs.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(scan, knn_kernel.NEAREST)
