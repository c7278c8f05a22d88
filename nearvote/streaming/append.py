"""Scoring a stream in append mode: every row by itself, without micro-batch functions.

Features and the profile shortcut are expressions and a join with a static table. The rest
meets references of a checked size that are broadcast, in a map over Arrow batches. So the
plan has no state, and each row leaves as soon as its batch is done. References beyond the
bound need a search that ranks across tasks: ``start`` runs it by micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearvote.config import DIMS, Normalization, ScoringConfig
from nearvote.functions import scores
from nearvote.operators import cells, knn, knn_kernel
from nearvote.operators.features import featurize, parse_requests
from nearvote.operators.index import profile_verdicts
from nearvote.sources.scratch import stored
from nearvote.streaming import scoring
from nearvote.streaming.warmup import warm_up


def split_oversized(requests: DataFrame, max_body: int) -> tuple[DataFrame, DataFrame]:
    """The (qid, value) rows whose body has at most ``max_body`` bytes, and (qid, octets) of the others.
    A missing body is not oversized."""
    octets = F.coalesce(F.octet_length("value"), F.lit(0))
    return requests.where(octets <= max_body), requests.where(octets > max_body).select("qid", octets.alias("octets"))


#: Blocks of references that a row passes one after the other, each of them a broadcast of ``block_bytes``.
MOST_BLOCKS = 4


def blocks_of(n: int, config: ScoringConfig) -> int:
    return max(1, -(-n * (DIMS + 2) * 8 // config.block_bytes))


class AppendScorer:
    """Scores rows in maps over references that are broadcast once, in cells, so that a row meets few.

    ``profile``: a table of ``index.profile_table``; with ``config.profile`` a pure key seen
    ``profile_min_count`` times decides by itself.
    """

    def __init__(self, references: DataFrame, norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None, profile: DataFrame | None = None):
        n = references.count()
        blocks = blocks_of(n, config)
        if blocks > MOST_BLOCKS:
            raise ValueError(f"{n} references exceed {MOST_BLOCKS} times block_bytes; score them by micro-batches")
        self.norm, self.config, self.risks = norm, config, risks
        self.profile = profile if config.profile else None
        parts = [references] if blocks == 1 else [references.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == i) for i in range(blocks)]
        broadcast = references.sparkSession.sparkContext.broadcast
        self.shared = [broadcast(cells.LocalCells(*knn_kernel.held(p, "ref_id", "vec", DIMS, "fraud"))) for p in parts]

    def score(self, requests: DataFrame) -> DataFrame:
        """(qid, parse_ok, path, fraud_count, approved, response) of each (qid, value) row, streaming
        or not: the same rows as ``scoring.score_requests`` with exact search."""
        ready = featurize(parse_requests(requests, "value", self.config.max_body), self.norm, self.risks).select("qid", "parse_ok", F.col("vec").cast("array<double>").alias("vec"))
        if self.profile is not None:
            # A barrier: the key reads the vector many times, and each would parse the request again.
            ready = ready.mapInArrow(lambda batches: batches, ready.schema)
        found = self._found(ready)
        count = F.col("fraud_count")
        return found.withColumn("approved", scores.approved(count)).withColumn("response", scores.response(count))

    def detect(self, vectors: DataFrame) -> DataFrame:
        """(qid, fraud_count, path) of each (qid, qv) row, a detector of ``scoring``."""
        ready = vectors.select("qid", F.lit(True).alias("parse_ok"), F.col("qv").alias("vec"))
        return self._found(ready).select("qid", "fraud_count", "path")

    def _found(self, ready: DataFrame) -> DataFrame:
        k = self.config.neighbours

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast, last: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                open_ = batch.column("qv").is_valid().to_numpy(zero_copy_only=False) & batch.column("known").is_null().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(open_)
                q = knn_kernel.matrix(batch.column("qv").take(pa.array(rows)), DIMS)
                best = shared.value.nearest(np.full(len(rows), -1), q, k, False)
                if "best" in batch.schema.names:  # of the blocks before
                    before = batch.column("best").take(pa.array(rows))
                    flat = before.flatten()
                    best.merge(np.repeat(np.arange(len(rows)), before.value_lengths().to_numpy(zero_copy_only=False)), *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)))
                if not last:
                    sizes = np.zeros(len(open_) + 1, np.int32)
                    sizes[rows + 1] = np.bincount(best.row, minlength=len(rows))
                    found = pa.StructArray.from_arrays([pa.array(best.rid), pa.array(best.fraud, pa.int32()), pa.array(best.d)], names=["ref_id", "fraud", "d"])
                    yield pa.record_batch([*(batch.column(c) for c in ("qid", "parse_ok", "qv", "known")), pa.ListArray.from_arrays(pa.array(sizes.cumsum().astype(np.int32)), found)], names=["qid", "parse_ok", "qv", "known", "best"])
                    continue
                count = batch.column("known").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
                count[rows] = np.bincount(best.row, best.fraud, len(rows)).astype(np.int32)
                path = np.where(open_, "exact", np.where(batch.column("known").is_valid().to_numpy(zero_copy_only=False), "profile", "fallback"))
                yield pa.record_batch([batch.column("qid"), batch.column("parse_ok"), pa.array(path.tolist(), pa.string()), pa.array(count)], names=["qid", "parse_ok", "path", "fraud_count"])

        known = F.lit(None).cast("int")
        if self.profile is not None:
            ready, known = profile_verdicts(ready, self.profile, self.config.profile_min_count), F.col("profile_count")
        rows = ready.select("qid", "parse_ok", F.col("vec").alias("qv"), known.alias("known"))
        for shared in self.shared[:-1]:
            rows = rows.mapInArrow(partial(scan, shared=shared, last=False), "qid long, parse_ok boolean, qv array<double>, known int, best array<struct<ref_id:bigint,fraud:int,d:double>>")
        return rows.mapInArrow(partial(scan, shared=self.shared[-1], last=True), "qid long, parse_ok boolean, path string, fraud_count int")


def batch_detector(references: DataFrame, config: ScoringConfig = ScoringConfig(), profile: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A detector of ``scoring`` that finds the same as ``AppendScorer.detect`` among references of any number."""
    known = stored(references.select("ref_id", "vec", "fraud"))

    def detect(vectors: DataFrame) -> DataFrame:
        rest, fast = vectors, None
        if config.profile and profile is not None:
            looked = stored(profile_verdicts(vectors.withColumn("vec", F.col("qv")), profile, config.profile_min_count))
            fast = looked.where("profile_count is not null").select("qid", F.col("profile_count").alias("fraud_count"), F.lit("profile").alias("path"))
            rest = looked.where("profile_count is null").select("qid", "qv")
        found = knn.vote(knn.nearest(rest, known, config.neighbours, DIMS, config, exclude_self=False), config.neighbours)
        exact = found.select("qid", "fraud_count", F.lit("exact").alias("path"))
        return exact if fast is None else fast.unionByName(exact)

    return detect


def detector(references: DataFrame, config: ScoringConfig = ScoringConfig()) -> Callable[[DataFrame], DataFrame]:
    """The scorer's detector where the references fit its blocks, else ``batch_detector``."""
    if blocks_of(references.count(), config) <= MOST_BLOCKS:
        return AppendScorer(references, config=config).detect
    return batch_detector(references, config)


def score_append(requests: DataFrame, references: DataFrame, norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """``AppendScorer.score`` of ``requests`` by a scorer of their own."""
    return AppendScorer(references, norm, config, risks, profile).score(requests)


def start(requests: DataFrame, references: DataFrame, out: str, rejects: str, checkpoint: str, once: bool = False, norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None, profile: DataFrame | None = None, warm: int = 0) -> tuple[StreamingQuery, StreamingQuery]:
    """Append scored rows to ``out`` and oversized bodies' (qid, octets) to ``rejects``, both Parquet;
    each output is a query with a checkpoint of its own. With ``warm`` above 0 the session scores
    that many drawn vectors a slot first, over the stream's own broadcast. References beyond a broadcast
    are searched by micro-batches, each of which is a folder ``batch=...`` of ``out``."""
    accepted, rejected = split_oversized(requests, config.max_body)
    if blocks_of(references.count(), config) > MOST_BLOCKS:
        detector = batch_detector(references, config, profile)
        if warm:
            warm_up(references.sparkSession, detector, per_slot=warm)
        scored = scoring.start(accepted, detector, lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{checkpoint}/scored", once, norm, config, risks)
        writer = rejected.writeStream.format("parquet").outputMode("append").option("path", rejects).option("checkpointLocation", f"{checkpoint}/rejected")
        return scored, (writer.trigger(availableNow=True) if once else writer).start()
    scorer = AppendScorer(references, norm, config, risks, profile)
    if warm:
        warm_up(references.sparkSession, scorer.detect, per_slot=warm)
    started = []
    for rows, path, name in ((scorer.score(accepted), out, "scored"), (rejected, rejects, "rejected")):
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append((writer.trigger(availableNow=True) if once else writer).start())
    return started[0], started[1]
