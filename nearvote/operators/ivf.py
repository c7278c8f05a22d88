"""Inverted-file search: probe the nearest clusters, then repair what they missed.

The first pass scans ``nprobe`` clusters for each query. Its worst distance bounds the
second: a cluster that the triangle inequality or its bounding box puts farther away
can hold no neighbour. With repair the result equals brute force in fixed point for any
clustering.

Queries that fit a block of a checked size are broadcast with the clusters they probe, and
members never move: a pass is a map over their Arrow batches that measures, cluster by cluster,
only the queries that want it, and shuffles k rows a query and batch at most. Where the
members are a table in cluster order, row groups that no query wants are not read. More
queries than that are routed to the clusters by shuffles (``routed``), and are repaired in
rounds with a bound that tightens; none of them comes to the driver.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.config import ScoringConfig
from nearvote.functions.vector import quantize
from nearvote.operators import cells, knn, knn_kernel, routed
from nearvote.operators.index import profile_verdicts
from nearvote.sources.scratch import stored


#: Rows of vectors that are bounded or refined at a time.
BOUND_ROWS = 1 << 12


@dataclass(frozen=True)
class Clusters:
    """What is known of the non-empty clusters, by place; ids ascend."""

    ids: np.ndarray
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray

    def far(self, q: np.ndarray) -> np.ndarray:
        """(queries, clusters) squared distances to the centroids; whole numbers, so exact."""
        return (q * q).sum(axis=1)[:, None] - 2 * (q @ self.centroids.T) + (self.centroids * self.centroids).sum(axis=1)[None, :]

    def may_hold(self, place: int, q: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Whether the cluster may hold something not farther than ``worst`` (NaN: anything); a few queries
        at a time, so that a worker's memory does not grow with them."""
        pieces = range(0, len(q), BOUND_ROWS)
        return np.concatenate([self._may_hold(place, q[a : a + BOUND_ROWS], worst[a : a + BOUND_ROWS]) for a in pieces] or [np.zeros(0, bool)])

    def _may_hold(self, place: int, q: np.ndarray, worst: np.ndarray) -> np.ndarray:
        open_ = np.isnan(worst)
        reach = self.radius[place] + np.ceil(np.sqrt(np.maximum(np.where(open_, 0.0, worst), 0.0)))
        step = q - self.centroids[place]
        near = np.flatnonzero(open_ | ((step * step).sum(axis=1) <= reach * reach))
        out = np.maximum(np.maximum(self.low[place] - q[near], q[near] - self.high[place]), 0)
        left = np.zeros(len(q), bool)
        left[near] = open_[near] | ((out * out).sum(axis=1) <= worst[near])
        return left


@dataclass(frozen=True)
class Nearest:
    """Squared distances in fixed point as scores below 0, for the routed search.

    The coarse bound is the triangle inequality's, the fine one also the box's. A distance is
    measured over ``head`` dimensions first, and finished where these leave it in reach.
    """

    known: Clusters
    head: int

    @property
    def ids(self) -> np.ndarray:
        return self.known.ids

    def triangle(self, far: np.ndarray) -> np.ndarray:
        """What the triangle inequality says that a member's distance is at least; a whole number."""
        gap = np.ceil(np.sqrt(far)) - self.known.radius
        return np.where(gap >= 1, (gap - 1) ** 2 + 1, 0)

    def box(self, q: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What the box of its cluster says of each row; a whole number."""
        out = np.maximum(np.maximum(self.known.low[place] - q, q - self.known.high[place]), 0)
        return (out * out).sum(axis=1)

    def bounds(self, q: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, None]:
        far = self.known.far(q)
        order = self.known.radius - np.ceil(np.sqrt(far))
        order[routed.leading(far, first)] = np.inf
        return order, -self.triangle(far), None

    def refine(self, q: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return -np.concatenate([self.box(q[row[a : a + BOUND_ROWS]], place[a : a + BOUND_ROWS]) for a in range(0, len(row), BOUND_ROWS)] or [np.zeros(0)])

    def scores(self, q: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, int]:
        def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]

        h = self.head
        d = apart(q[:, :h], v[:, :h])
        live = d <= -least.astype(np.float64)[:, None]
        row, col = np.nonzero(live)
        if h >= q.shape[1] or 4 * len(row) > d.size:  # a second product is cheaper than many single rows
            return -(d + apart(q[:, h:], v[:, h:])).astype(np.int64), 0
        score = np.full(d.shape, routed.LEAST)
        for a in range(0, len(row), BOUND_ROWS):
            r, c = row[a : a + BOUND_ROWS], col[a : a + BOUND_ROWS]
            step = q[r, h:] - v[c, h:]
            score[r, c] = -(d[r, c] + (step * step).sum(axis=1)).astype(np.int64)
        return score, d.size - len(row)


def bound_table(queries: DataFrame, clusters: DataFrame, dims: int) -> DataFrame:
    """(qid, cluster_id, dc, triangle, box, probe) of every fixed (qid, qv) and cluster: what the routed
    search prunes by, in a report of all pairs. ``probe`` is a cluster's rank by its centroid's distance."""
    shared = queries.sparkSession.sparkContext.broadcast(Nearest(fetch_clusters(clusters, dims), dims))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = shared.value.ids
            q = knn_kernel.matrix(batch.column(1), dims)
            far = shared.value.known.far(q)
            triangle = shared.value.triangle(far)
            box = np.stack([shared.value.box(q, np.full(len(q), i)) for i in range(len(ids))], axis=1)
            rank = np.empty(far.shape, np.int32)
            np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(1, len(ids) + 1, dtype=np.int32)[None, :], axis=1)
            at = pa.array(np.repeat(np.arange(len(far)), len(ids)))
            numbers = [pa.array(x.ravel().astype(np.int64)) for x in (far, triangle, box)]
            yield pa.record_batch([batch.column(0).take(at), pa.array(np.tile(ids, len(far)), pa.int32()), *numbers, pa.array(rank.ravel())], names=["qid", "cluster_id", "dc", "triangle", "box", "probe"])

    return queries.select("qid", F.col("qv").cast("array<double>")).mapInArrow(bound, "qid long, cluster_id int, dc long, triangle long, box long, probe int")


def fetch_clusters(clusters: DataFrame, dims: int) -> Clusters:
    """The clusters on the driver: a few numbers for each dimension and cluster."""
    table = clusters.select("cluster_id", "centroid", "low", "high", "radius").toArrow().sort_by("cluster_id").combine_chunks()
    ids, *boxes, radius = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    return Clusters(ids.to_numpy(zero_copy_only=False), *(knn_kernel.matrix(c, dims) for c in boxes), radius.to_numpy(zero_copy_only=False).astype(np.float64))


def probed(queries: DataFrame, known: Clusters, dims: int, nprobe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, places of the probed clusters) of a block of fixed (qid, qv)."""
    shared = queries.sparkSession.sparkContext.broadcast(known)
    n = min(nprobe, len(known.ids))
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("qv", T.ArrayType(T.DoubleType())), T.StructField("probes", T.ArrayType(T.IntegerType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = knn_kernel.matrix(batch.column(1), dims)
            # Equal distances: the lower id first.
            first = np.argsort(shared.value.far(q), axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (q, first)]
            yield pa.record_batch([batch.column(0), *lists], names=schema.names)

    table = queries.select("qid", "qv").mapInArrow(choose, schema).toArrow().combine_chunks()
    ids, q, places = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    return ids.to_numpy(zero_copy_only=False), knn_kernel.matrix(q, dims), places.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def scan_clusters(members: DataFrame, known: Clusters, block: tuple[np.ndarray, np.ndarray, np.ndarray], worst: np.ndarray | None, dims: int, k: int, exclude_self: bool) -> DataFrame:
    """(qid, ref_id, fraud, d): of each task's members the k nearest of the probed clusters, or,
    given ``worst`` distances, those of the unprobed clusters that are not farther.

    A ``worst`` below 0 leaves its query out."""
    # Who probes a place, found once for all tasks: the probe lists inverted.
    order = np.argsort(block[2], axis=None, kind="stable")
    cuts = np.searchsorted(block[2].ravel()[order], np.arange(len(known.ids) + 1))
    probers = order // max(1, block[2].shape[1]), cuts
    shared = members.sparkSession.sparkContext.broadcast((known, block[:2], probers, worst))
    packed = "ids" in members.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (qid, q), (probers, cuts), worst = shared.value
        wanting: dict[int, np.ndarray] = {}
        best = knn_kernel.Best(qid, q, k, exclude_self)
        if worst is not None:
            best.worst = np.where(np.isnan(worst), np.inf, worst)
        for batch in batches:
            new, size = [], 0
            for c, rid, fraud, r in (_listed if packed else _by_cluster)(batch, dims):
                place = int(np.searchsorted(known.ids, c))
                if c not in wanting:
                    probing = probers[cuts[place] : cuts[place + 1]]
                    if worst is None:
                        wanting[c] = np.sort(probing)
                    else:
                        left = known.may_hold(place, q, worst)
                        left[probing] = False
                        wanting[c] = np.flatnonzero(left)
                own = wanting[c]
                if not own.size:
                    continue
                at, to, d = knn_kernel.nearest_block(qid[own], q[own], rid, r, k, exclude_self, best.worst[own])
                new.append((own[at], rid[to], fraud[to], d))
                size += len(at)
                if size > max(k * len(q), 1 << 16):  # a batch of packed lists may hold many clusters
                    best.merge(*map(np.concatenate, zip(*new)))
                    new, size = [], 0
            if size:
                best.merge(*map(np.concatenate, zip(*new)))
        yield from best.batches()

    wanted = ("cluster_id", "ids", "marks", "q") if packed else ("ref_id", "fraud", "cluster_id", "q")
    return members.select(*wanted).mapInArrow(scan, knn_kernel.NEAREST)


def _by_cluster(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cluster, ids, frauds, vectors) of a batch of member rows."""
    rid, fraud, cluster = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
    r = knn_kernel.matrix(batch.column(3), dims)
    for c in np.unique(cluster).tolist():
        rows = np.flatnonzero(cluster == c)
        yield c, rid[rows], fraud[rows], r[rows]


def _listed(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cluster, ids, frauds, vectors) of a batch of packed lists."""
    for i, c in enumerate(batch.column(0).to_pylist()):
        rid, fraud = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (1, 2))
        yield c, rid, fraud, batch.column(3)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


@dataclass
class SearchStats:
    """What a search did: seconds by stage, and (query, non-empty cluster) pairs.

    ``probed`` pairs are scanned by the first pass; of the others the second scans the
    ``repaired`` ones and the bounds rule out the ``pruned`` ones.
    """

    seconds: dict[str, float] = field(default_factory=dict)
    probed: int = 0
    repaired: int = 0
    pruned: int = 0


@contextlib.contextmanager
def _timed(stats: SearchStats | None, stage: str) -> Iterator[None]:
    began = time.perf_counter()
    yield
    if stats is not None:
        stats.seconds[stage] = stats.seconds.get(stage, 0.0) + time.perf_counter() - began


def repaired_pairs(spark: SparkSession, known: Clusters, block: tuple[np.ndarray, np.ndarray, np.ndarray], worst: np.ndarray) -> int:
    """How many unprobed (query, cluster) pairs the second pass scans, counted cluster by cluster."""
    shared = spark.sparkContext.broadcast((known, block, worst))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (_, q, places), worst = shared.value
        for batch in batches:
            n = [int((~(places == place).any(axis=1) & known.may_hold(place, q, worst)).sum()) for place in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(n, pa.int64())], names=["n"])

    return spark.range(len(known.ids)).mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def search(queries: DataFrame, members: DataFrame | cells.Cells, clusters: DataFrame | None, dims: int, k: int, nprobe: int, repair: bool = True, exclude_self: bool = True, config: ScoringConfig = ScoringConfig(), stats: SearchStats | None = None) -> DataFrame:
    """(qid, ref_id, fraud, d, rk): the k nearest in fixed point.

    ``queries`` has float (qid, qv); ``members`` fixed (ref_id, q, fraud, cluster_id), or the packed
    lists of ``routed.inverted_lists`` with frauds as marks. The first pass runs at once; its
    candidates are written to the shared folder. With ``stats`` both passes run at once, to be
    timed and counted. More queries than ``block_bytes`` are routed. Members may also be the cells of
    fixed references, which are searched in two passes of their own.
    """
    fixed = queries.select("qid", quantize(F.col("qv")).alias("qv"))
    if isinstance(members, cells.Cells):
        return cells.nearest(fixed, members, k, exclude_self)
    if fixed.count() * (dims + 2) * 8 > config.block_bytes:
        return search_routed(queries, members, clusters, dims, k, nprobe, repair, exclude_self, config, stats)
    return _search(fixed, members, fetch_clusters(clusters, dims), dims, k, nprobe, repair, exclude_self, config, stats)


def packed_lists(members: DataFrame) -> DataFrame:
    """Packed lists of member rows, written to the shared folder; lists stay as they are."""
    if "ids" in members.columns:
        return members
    return stored(routed.inverted_lists(members.select("ref_id", F.col("fraud").alias("mark"), "cluster_id", "q")))


def search_routed(queries: DataFrame, members: DataFrame, clusters: DataFrame, dims: int, k: int, nprobe: int, repair: bool = True, exclude_self: bool = True, config: ScoringConfig = ScoringConfig(), stats: SearchStats | None = None, seen: routed.RoutedStats | None = None) -> DataFrame:
    """As ``search``, for queries of any number: they meet the clusters by shuffles.

    The first round visits ``nprobe`` clusters, the next ones, twice as many each, those that the
    bounds leave, nearest bound first. ``seen`` is filled with the counters of the rounds.
    """
    lists = packed_lists(members)
    known = fetch_clusters(clusters.where("cnt > 0") if "cnt" in clusters.columns else clusters, dims)
    ready = queries.select("qid", quantize(F.col("qv")).alias("q"), F.lit(0).alias("mark"), F.array(F.lit(routed.LEAST)).alias("lows"), F.array(F.lit(routed.MOST)).alias("highs"))
    plan = routed.RoutedConfig(first=nprobe, growth=2)
    metric = Nearest(known, min(config.early_exit_dims, dims))

    def run(some: DataFrame, rounds: int | None, into: routed.RoutedStats | None) -> DataFrame:
        found = routed.search(some, lists, metric, dims, k, exclude_self=exclude_self, config=plan, stats=into, rounds=rounds)
        return found.select("qid", "ref_id", F.col("mark").alias("fraud"), (-F.col("score")).cast("double").alias("d"), "rk")

    seen = routed.RoutedStats() if seen is None and stats is not None else seen
    if repair and (config.unanimity_skip or config.deterministic_skip):
        first = stored(run(ready, 1, None))
        frauds, full = F.sum("fraud"), F.count("*") == k
        sure = F.lit(False)
        if config.unanimity_skip:
            sure |= full & frauds.isin(0, k)
        if config.deterministic_skip:
            sure |= full & ((frauds <= 1) | (frauds >= k - 1))
        done = stored(first.groupBy("qid").agg(sure.alias("sure")).where("sure").select("qid"))
        again = run(ready.join(done, "qid", "left_anti"), None, seen)
        out = first.join(done, "qid", "left_semi").unionByName(again)
    else:
        out = run(ready, None if repair else 1, seen)
    if stats is not None:
        stats.seconds["scan"] = stats.seconds.get("scan", 0.0) + sum(seen.seconds[:1])
        stats.seconds["repair"] = stats.seconds.get("repair", 0.0) + sum(seen.seconds[1:])
        stats.probed += sum(seen.pairs[:1])
        stats.repaired += sum(seen.pairs[1:])
        stats.pruned += seen.coarse + seen.fine
    return out


def _search(queries: DataFrame, members: DataFrame, known: Clusters, dims: int, k: int, nprobe: int, repair: bool, exclude_self: bool, config: ScoringConfig, stats: SearchStats | None) -> DataFrame:
    with _timed(stats, "centroid"):
        block = probed(queries, known, dims, nprobe)
    used = np.unique(block[2])
    some = members
    if len(used) < len(known.ids):
        some = members.where(F.col("cluster_id").isin([int(known.ids[i]) for i in used]))
    first = knn.ranked(scan_clusters(some, known, block, None, dims, k, exclude_self), k)
    if not repair and stats is None:
        return first
    with _timed(stats, "scan"):
        first = stored(first)
    if stats is not None:
        stats.probed += block[2].size
    if not repair:
        return first
    state = first.groupBy("qid").agg(F.max("d").alias("worst"), F.sum("fraud").alias("frauds"), F.count("*").alias("found"))
    got = state.toArrow()  # a row for each query of the block
    qid, worst, frauds, found = (got.column(i).to_numpy() for i in range(4))
    skip = np.zeros(len(qid), bool)
    if config.unanimity_skip:
        skip |= (found == k) & np.isin(frauds, (0, k))
    if config.deterministic_skip:
        skip |= (found == k) & ((frauds <= 1) | (frauds >= k - 1))
    bounds = np.full(len(block[0]), np.nan)  # too few candidates: no bound
    order = np.argsort(block[0])
    bounds[order[np.searchsorted(block[0], qid, sorter=order)]] = np.where(skip, -1.0, np.where(found == k, worst, np.nan))
    second = scan_clusters(members, known, block, bounds, dims, k, exclude_self)
    both = knn.ranked(first.drop("rk").unionByName(second), k)
    if stats is not None:
        with _timed(stats, "repair"):
            both = stored(both)
        again = repaired_pairs(members.sparkSession, known, block, bounds)
        stats.repaired += again
        stats.pruned += len(block[0]) * len(known.ids) - block[2].size - again
    return both


def score(queries: DataFrame, references: DataFrame, members: DataFrame | cells.Cells, clusters: DataFrame | None, dims: int, config: ScoringConfig = ScoringConfig(), profile: DataFrame | None = None, exclude_self: bool = True, stats: SearchStats | None = None) -> DataFrame:
    """(qid, fraud_count, path, approved, fraud_score): profile shortcut, search, rerank."""
    rest = queries
    fast = None
    if config.profile and profile is not None:
        looked = profile_verdicts(queries.withColumn("vec", F.col("qv")), profile, config.profile_min_count)
        fast = knn.verdict(looked.where("profile_count is not null").select("qid", F.col("profile_count").alias("fraud_count"), F.lit("profile").alias("path")))
        rest = looked.where("profile_count is null").select("qid", "qv")
    found = search(rest, members, clusters, dims, config.candidates, config.nprobe, config.repair, exclude_self, config, stats)
    with _timed(stats, "rerank"):
        done = knn.decide(found, rest, references, dims, config)
        if stats is not None:
            done = stored(done)
    return done if fast is None else fast.unionByName(done)
