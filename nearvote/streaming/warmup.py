"""Warm-up: a task a slot that scores throw-away requests before the first real one.

It starts the Python workers, ships the detector's broadcasts to every executor and has the plan's
code compiled, so that the first requests don't wait for these.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearvote.config import Normalization
from nearvote.operators import generate
from nearvote.operators.features import featurize, parse_requests


@dataclass(frozen=True)
class WarmUp:
    """``scored``: payload lines; ``skipped``: malformed ones; ``drawn``: generated vectors."""

    scored: int
    skipped: int
    drawn: int
    seconds: float


def warm_up(spark: SparkSession, detector: Callable[[DataFrame], DataFrame], payloads: DataFrame | None = None, per_slot: int = 200, slots: int | None = None, norm: Normalization = Normalization(), risks: dict[str, float] | None = None, seed: int = 42) -> WarmUp:
    """Score ``payloads``, (value) lines, spread over ``slots`` tasks (all cores of the session unless
    given), and drawn vectors where they are fewer than ``per_slot`` a slot.

    ``detector`` maps (qid, qv) to rows by qid, as in ``scoring``. Null and malformed lines are
    skipped and counted. ``payloads`` are scored whole: give a file made for this, or a limit of it.
    """
    began = time.perf_counter()
    slots = slots or spark.sparkContext.defaultParallelism
    scored = skipped = 0
    if payloads is not None:
        lines = payloads.select("value").repartition(slots).withColumn("qid", F.monotonically_increasing_id())
        seen = Observation()
        parsed = parse_requests(lines).observe(seen, F.count_if("parse_ok").alias("ok"), F.count_if(~F.col("parse_ok")).alias("bad"))
        real = featurize(parsed, norm, risks).where("vec is not null")
        _discard(detector(real.select("qid", F.col("vec").cast("array<double>").alias("qv"))))
        scored, skipped = seen.get["ok"], seen.get["bad"]
    drawn = max(0, slots * per_slot - scored)
    if drawn:
        _discard(detector(generate.query_vectors(spark, drawn, seed).repartition(slots)))
    return WarmUp(scored, skipped, drawn, time.perf_counter() - began)


def _discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()
