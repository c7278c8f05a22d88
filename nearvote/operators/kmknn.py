"""Two-pass search: a quick pass for all queries, a full one for the borderline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.operators import ivf, knn
from nearvote.sources.scratch import stored


def score(queries: DataFrame, members: DataFrame, clusters: DataFrame, dims: int, config: ScoringConfig = ScoringConfig(), exclude_self: bool = True) -> DataFrame:
    """(qid, fraud_count, path, approved, fraud_score) by the k nearest in fixed point.

    Pass 1 probes ``nprobe`` clusters without repair. Queries with 2 to 4 frauds are
    searched again with ``nprobe_full`` clusters and repair.
    """
    k = config.neighbours
    quick = ivf.search(queries, members, clusters, dims, k, config.nprobe, repair=False, exclude_self=exclude_self)
    counted = stored(quick.groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count")))
    sure = counted.where(~F.col("fraud_count").between(2, 4)).withColumn("path", F.lit("pass1"))
    unsure = queries.join(counted.where(F.col("fraud_count").between(2, 4)).select("qid"), "qid", "left_semi")
    full = ivf.search(unsure, members, clusters, dims, k, config.nprobe_full, repair=True, exclude_self=exclude_self)
    again = full.groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count")).withColumn("path", F.lit("pass2"))
    return knn.verdict(sure.unionByName(again))
