"""Best-first search of inverted lists, in rounds, with queries routed to clusters by shuffles.

No query comes to the driver. In a round each query wants the next clusters in the order of
their bounds; a cluster whose bound says that it holds nothing better than the query's
k-th result is pruned, and since every round raises that result, later rounds prune more.
The wanted (query, cluster) pairs are shuffled by cluster and meet the cluster's members in a
cogroup. Cells are bounded on both sides: the members of a large cluster are dealt over several
cells, and so are the queries of a cluster that many want. The state of a round is a table
in the shared folder, so a lost executor costs its tasks and no more.

Scores are whole numbers and higher ones are better; equal scores go to the lower id.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.sources.scratch import stored

#: Bounds of 64 bits: no result yet, no upper end of a window.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BEST = "array<struct<slot:int,score:bigint,ref_id:bigint,mark:int>>"


class Metric(Protocol):
    """What a search needs to know of its scores and clusters; shipped to the tasks."""

    ids: np.ndarray

    def bounds(self, q: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(order, upper, lower) for each query and cluster: visits go by descending ``order``, in which
        the upper bounds must not rise but for the ``first`` visits; ``lower`` is None where windows
        have no upper end."""
        ...

    def refine(self, q: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray | None:
        """A tighter and dearer upper bound of some pairs; None where there is none."""
        ...

    def scores(self, q: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, int]:
        """(queries, members) scores, LEAST where one was abandoned below ``least``, and how many were."""
        ...


@dataclass(frozen=True)
class RoutedConfig:
    """``first`` clusters are visited in the first round, ``growth`` times as many in each next one.
    A list row holds about ``block_rows`` members, a cell ``cell_blocks`` of these and
    ``cell_queries`` queries. A task finds about ``task_bounds`` bounds."""

    first: int = 4
    growth: int = 4
    block_rows: int = 2048
    cell_blocks: int = 8
    cell_queries: int = 4096
    task_bounds: int = 1 << 22


@dataclass
class RoutedStats:
    """What a search did, observed in the passes that do it. ``pairs`` of (query, cluster) were
    scanned, a figure for each round; the others were pruned: by the ``coarse`` bound alone, or by
    the ``fine`` one. Of the ``measured`` (query, member) pairs some were ``abandoned`` after
    the leading dimensions. ``seconds`` are those of the rounds."""

    pairs: list[int] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)
    coarse: int = 0
    fine: int = 0
    measured: int = 0
    abandoned: int = 0


def inverted_lists(members: DataFrame, config: RoutedConfig = RoutedConfig()) -> DataFrame:
    """(cluster_id, part, ids, marks, q): the members (ref_id, mark, cluster_id, q) packed in rows of
    about ``block_rows``; the q of a row follow one another, nearest first where members have ``d``."""
    parts = members.groupBy("cluster_id").agg(F.ceil(F.count("*") / config.block_rows).cast("int").alias("parts"))  # a row a cluster
    dealt = members.join(F.broadcast(parts), "cluster_id").withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list(F.struct(*(c for c in ("d", "ref_id", "mark", "q") if c in members.columns)))).alias("m"))
    return packed.select("cluster_id", "part", F.col("m.ref_id").alias("ids"), F.col("m.mark").alias("marks"), F.flatten("m.q").alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Whole numbers as doubles, or as 64-bit integers where doubles would not tell them apart."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.int64 or not len(flat) or max(int(flat.max()), -int(flat.min())) < 1 << 24:
        flat = flat.astype(np.float64)
    return flat.reshape(-1, dims)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where these suffice, else in 64 bits.
    Beyond that an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = math.prod(max(float(x.max()), -float(x.min())) for x in (a, b)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _windows(batch: pa.RecordBatch | pa.Table, slots: int, *names: str) -> list[np.ndarray]:
    out = []
    for name in names:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, slots))
    return out


def _kth(best: pa.Array, slots: int, k: int) -> np.ndarray:
    """(queries, slots): each slot's k-th score, LEAST where it has fewer results."""
    out = np.full((len(best), slots), MOST)
    row = np.repeat(np.arange(len(best)), best.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = best.flatten()
    slot, score = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    np.minimum.at(out, (row, slot), score)
    full = np.zeros((len(best), slots), np.int64)
    np.add.at(full, (row, slot), 1)
    return np.where(full >= k, out, LEAST)


@dataclass(frozen=True)
class _Plan:
    """What the queries of a batch want in a round."""

    metric: Metric
    slots: int
    k: int
    dims: int
    first: int
    done: int
    step: int

    def wanted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch with, for each query, ``floors``, the wanted ``places`` of clusters, and other pairs:
        those of this round that the coarse and the fine bound prune, those of later rounds that
        the coarse bound prunes now, and those that it leaves."""
        q = matrix(batch.column("q"), self.dims)
        lows, highs = _windows(batch, self.slots, "lows", "highs")
        floors = np.maximum(lows, _kth(batch.column("best"), self.slots, self.k))
        size = max(1, (1 << 20) // max(1, len(self.metric.ids)))
        sizes, places, others = [], [], []
        for a in range(0, len(q), size):
            rows = slice(a, min(a + size, len(q)))
            order, upper, lower = self.metric.bounds(q[rows], self.first)
            eligible, near = np.zeros(upper.shape, bool), np.zeros(upper.shape, bool)
            for s in range(self.slots):
                low, high, floor = lows[rows, s, None], highs[rows, s, None], floors[rows, s, None]
                inside = (low <= high) & (np.True_ if lower is None else lower <= high)
                eligible |= inside & (upper >= low)
                near |= inside & (upper >= floor)
            order = np.where(eligible, -order, np.inf)
            later = ~leading(order, self.done + self.step)
            open_ = ~leading(order, self.done) & ~later
            now = near & open_
            row, place = np.nonzero(now)
            fine = self.metric.refine(q[rows], row, place)
            if fine is not None:
                keep = (fine[:, None] >= floors[rows][row]).any(axis=1)
                row, place = row[keep], place[keep]
            sizes.append(np.bincount(row, minlength=rows.stop - rows.start))
            places.append(place)
            others.append(np.stack([(open_ & ~near).sum(axis=1), now.sum(axis=1) - sizes[-1], (later & ~near).sum(axis=1), (later & near).sum(axis=1)], axis=1))
        ends = pa.array(np.concatenate([[0], *(sizes or [[]])]).cumsum().astype(np.int32))
        want = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places or [np.zeros(0)]).astype(np.int32)))
        other = np.concatenate(others or [np.zeros((0, 4))]).astype(np.int64)
        told = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * 4, pa.int32()), pa.array(other.ravel()))
        windows = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * self.slots, pa.int32()), pa.array(floors.ravel()))
        return pa.record_batch([*(batch.column(c) for c in STATE), windows, want, told], names=[*STATE, "floors", "places", "others"])


STATE = ("qid", "q", "mark", "lows", "highs", "best")


def leading(order: np.ndarray, n: int) -> np.ndarray:
    """Whether an entry is among its row's ``n`` least, the first of equal ones."""
    if n <= 0 or n >= order.shape[1]:
        return np.full(order.shape, n > 0)
    last = np.partition(order, n - 1, axis=1)[:, n - 1, None]
    below, equal = order < last, order == last
    return below | (equal & (np.cumsum(equal, axis=1) <= n - below.sum(axis=1, keepdims=True)))


def search(queries: DataFrame, lists: DataFrame, metric: Metric, dims: int, k: int, slots: int = 1, same_mark: bool | None = None, exclude_self: bool = True, config: RoutedConfig = RoutedConfig(), stats: RoutedStats | None = None, rounds: int | None = None) -> DataFrame:
    """(qid, slot, ref_id, score, mark, rk): the k best of each query and slot, of ``rounds`` at most.

    ``queries`` has (qid, q, mark) and, for each slot, a window of scores: ``lows`` and ``highs``,
    arrays of longs. With ``same_mark`` only members of the query's mark count, with False
    only those of other marks. Query ids must be unique.
    """
    spark = queries.sparkSession
    parts = {r[0]: r[1] for r in lists.groupBy("cluster_id").agg(F.max("part") + 1).collect()}  # a row a cluster
    cells = {c: math.ceil(n / config.cell_blocks) for c, n in parts.items()}
    state = queries.select("qid", "q", "mark", "lows", "highs", F.array().cast(BEST).alias("best"))
    kind = state.schema["q"].dataType.simpleString()
    # Bounds cost queries * clusters, whatever their bytes: tasks are cut by that.
    tasks = max(1, math.ceil(queries.count() * len(metric.ids) / config.task_bounds))
    done, step, turn = 0, config.first, 0
    while done < len(metric.ids) and turn != rounds:
        began, turn = time.perf_counter(), turn + 1
        shared = spark.sparkContext.broadcast(_Plan(metric, slots, k, dims, config.first, done, step))

        def want(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from map(shared.value.wanted, batches)

        def count(batches: Iterator[pa.RecordBatch], n=len(metric.ids)) -> Iterator[pa.RecordBatch]:
            pairs, others = np.zeros(n, np.int64), np.zeros(4, np.int64)
            for batch in batches:
                places, other = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                pairs += np.bincount(places, minlength=n)
                others += other.reshape(-1, 4).sum(axis=0)
            at = np.flatnonzero(pairs)
            yield pa.record_batch([pa.array([*at.tolist(), *range(-4, 0)], pa.int32()), pa.array([*pairs[at].tolist(), *others.tolist()], pa.int64())], names=["place", "n"])

        dealt = state.repartition(tasks, "qid") if tasks > 1 else state
        state = stored(dealt.select(*STATE).mapInArrow(want, f"qid long, q {kind}, mark int, lows array<bigint>, highs array<bigint>, best {BEST}, floors array<bigint>, places array<int>, others array<bigint>"))
        counted = {r[0]: r[1] for r in state.select("places", "others").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n")).collect()}
        coarse, fine, coarse_later, near_later = (counted.pop(i, 0) for i in range(-4, 0))
        counted = {metric.ids.item(i): n for i, n in counted.items() if metric.ids.item(i) in cells}
        last = not counted and not near_later
        if stats is not None:
            stats.pairs.append(sum(counted.values()))
            stats.coarse += coarse + (coarse_later if last else 0)
            stats.fine += fine
        if counted:
            chunks = {c: math.ceil(n / config.cell_queries) for c, n in counted.items()}
            seen = Observation() if stats is not None else None
            state = stored(_visit(state, lists, shared, cells, chunks, k, slots, same_mark, exclude_self, config, seen))
            if seen is not None:
                stats.measured += seen.get["measured"] or 0
                stats.abandoned += seen.get["abandoned"] or 0
        if stats is not None:
            stats.seconds.append(time.perf_counter() - began)
        shared.destroy()
        if last:
            break
        done, step = done + step, step * config.growth
    best = state.select("qid", F.explode("best").alias("b")).select("qid", "b.*")
    return best.withColumn("rk", F.row_number().over(W.partitionBy("qid", "slot").orderBy(F.desc("score"), "ref_id")))


def _visit(state: DataFrame, lists: DataFrame, shared, cells: dict[int, int], chunks: dict[int, int], k: int, slots: int, same_mark: bool | None, exclude_self: bool, config: RoutedConfig, seen: Observation | None) -> DataFrame:
    """The state after the wanted clusters have been scanned."""
    spark = state.sparkSession
    dims = shared.value.dims
    kind = state.schema["q"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.metric.ids
        n_cells = np.array([cells.get(c, 0) for c in ids.tolist()])
        n_chunks = np.array([chunks.get(c, 1) for c in ids.tolist()])
        for batch in batches:
            qid = batch.column("qid").to_numpy(zero_copy_only=False)
            spread = (qid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            wants = batch.column("places")
            place = wants.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(qid)), wants.value_lengths().to_numpy(zero_copy_only=False))
            copies = n_cells[place]
            row, place = np.repeat(row, copies), np.repeat(place, copies)
            cell = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            for a in range(0, len(row), config.cell_queries):  # small batches: each row carries a vector
                r, p, c = row[a : a + config.cell_queries], place[a : a + config.cell_queries], cell[a : a + config.cell_queries]
                chunk = (spread[r] % n_chunks[p].astype(np.uint64)).astype(np.int32)
                at = pa.array(r)
                yield pa.record_batch([pa.array(ids[p], pa.int32()), pa.array(c, pa.int32()), pa.array(chunk), *(batch.column(x).take(at) for x in ("qid", "q", "mark", "floors", "highs"))], names=["cluster_id", "cell", "chunk", "qid", "q", "mark", "floors", "highs"])

    def scan(pairs: pa.Table, blocks: pa.Table) -> pa.Table:
        metric = shared.value.metric
        v, q = matrix(blocks.column("q"), dims), matrix(pairs.column("q"), dims)
        rid, marks = (blocks.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "marks"))
        qid, mark = (pairs.column(c).to_numpy() for c in ("qid", "mark"))
        floors, highs = _windows(pairs, slots, "floors", "highs")
        found, abandoned = [], 0
        size = max(1, (1 << 20) // max(1, len(v)))
        for a in range(0, len(q), size):
            part = slice(a, a + size)
            score, left = metric.scores(q[part], v, floors[part].min(axis=1))
            abandoned += left
            allowed = np.ones(score.shape, bool) if same_mark is None else (mark[part, None] == marks[None, :]) == same_mark
            if exclude_self:
                allowed &= qid[part, None] != rid[None, :]
            for s in range(slots):
                ok = allowed & (score >= np.maximum(floors[part, s, None], LEAST + 1)) & (score <= highs[part, s, None])
                row, col = _top(np.where(ok, score, LEAST), rid, k)
                found.append((qid[part][row], np.full(len(row), s), rid[col], score[row, col], marks[col]))
        # The last row tells what was measured.
        columns = [np.concatenate(x) for x in zip(*found, ([0], [-1], [len(q) * len(v)], [abandoned], [0]))]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["qid", "slot", "ref_id", "score", "mark"])

    pairs = state.where(F.size("places") > 0).select("qid", "q", "mark", "highs", "floors", "places").mapInArrow(route, f"cluster_id int, cell int, chunk int, qid long, q {kind}, mark int, floors array<bigint>, highs array<bigint>")
    copies = spark.createDataFrame(sorted(chunks.items()), "cluster_id int, chunks int")  # a row a cluster
    some = lists if len(chunks) == len(cells) else lists.where(F.col("cluster_id").isin(sorted(chunks)))
    blocks = some.join(F.broadcast(copies), "cluster_id").select("cluster_id", F.floor(F.col("part") / config.cell_blocks).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "ids", "marks", "q")
    key = ["cluster_id", "cell", "chunk"]
    found = pairs.groupBy(key).cogroup(blocks.groupBy(key)).applyInArrow(scan, "qid long, slot int, ref_id long, score long, mark int")
    if seen is not None:
        told = F.col("slot") < 0
        found = found.observe(seen, F.sum(F.when(told, F.col("ref_id"))).alias("measured"), F.sum(F.when(told, F.col("score"))).alias("abandoned"))
    before = state.select("qid", F.explode("best").alias("b")).select("qid", "b.slot", "b.ref_id", "b.score", "b.mark")
    order = W.partitionBy("qid", "slot").orderBy(F.desc("score"), "ref_id")
    kept = found.where("slot >= 0").unionByName(before).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    best = kept.groupBy("qid").agg(F.collect_list(F.struct("slot", "score", "ref_id", "mark")).alias("found"))  # slots * k rows
    return state.select("qid", "q", "mark", "lows", "highs").join(best, "qid", "left").withColumn("best", F.coalesce("found", F.array().cast(BEST))).drop("found")


def _top(score: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best scores above LEAST, equal ones by lower id."""
    n = score.shape[1]
    if n > k:
        reach = np.partition(score, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((score >= reach[:, None]) & (score > LEAST))
    else:
        row, col = np.nonzero(score > LEAST)
    order = np.lexsort((rid[col], -score[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


@dataclass(frozen=True)
class InnerProduct:
    """Inner products: by Cauchy and Schwarz a member's is within |q| * radius of the centroid's.

    Centroids are whole numbers, so that a bound is the same however queries are batched.
    """

    ids: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray

    def bounds(self, q: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = product(q, self.centroids).astype(np.float64)
        reach = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.radius[None, :]
        reach = reach * (1 + 1e-9) + np.abs(middle) * 1e-12 + 1e-6
        return middle + reach, middle + reach, middle - reach

    def refine(self, q: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        return None

    def scores(self, q: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, int]:
        return product(q, v), 0
