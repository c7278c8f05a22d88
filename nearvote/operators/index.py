"""What an index knows about its clusters and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.functions.vector import profile_key, quantize, squared_distance
from nearvote.sources.scratch import stored


def cluster_stats(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, cnt, centroid, low, high, radius) in fixed point.

    ``assigned`` has float ``vec``; the box holds every quantised member, the radius is
    the root of the largest squared distance to the quantised centroid, rounded up. An
    empty cluster's box is its centroid, its radius 0.
    """
    fixed = centroids.select("cluster_id", quantize(F.col("centroid")).alias("centroid"))
    members = assigned.select("cluster_id", quantize(F.col("vec")).alias("q")).join(F.broadcast(fixed), "cluster_id")
    far = squared_distance(F.col("q"), F.col("centroid"), dims)
    stats = members.groupBy("cluster_id").agg(
        F.count("*").alias("cnt"),
        F.array(*(F.min(F.get("q", F.lit(i))) for i in range(dims))).alias("low"),
        F.array(*(F.max(F.get("q", F.lit(i))) for i in range(dims))).alias("high"),
        F.ceil(F.sqrt(F.max(far))).cast("int").alias("radius"),
    )
    return fixed.join(stats, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        "centroid",
        F.coalesce("low", "centroid").alias("low"),
        F.coalesce("high", "centroid").alias("high"),
        F.coalesce("radius", F.lit(0)).alias("radius"),
    )


def profile_table(references: DataFrame) -> DataFrame:
    """(pkey, mask, cnt): per profile key which labels occur (1 legitimate, 2 fraud) and how often."""
    keyed = references.select(profile_key(quantize(F.col("vec"))).alias("pkey"), "fraud")
    mask = F.bit_or(F.when(F.col("fraud") == 1, F.lit(2)).otherwise(F.lit(1)))
    return keyed.groupBy("pkey").agg(mask.alias("mask"), F.least(F.count("*"), F.lit(65535)).cast("int").alias("cnt"))


def profile_census(table: DataFrame, bits: int = 22) -> DataFrame:
    """One row: keys with only legitimate, only fraudulent and mixed references, and empty ones."""
    return table.agg(
        F.count_if(F.col("mask") == 1).alias("pure_legit"),
        F.count_if(F.col("mask") == 2).alias("pure_fraud"),
        F.count_if(F.col("mask") == 3).alias("mixed"),
        (F.lit(1 << bits) - F.count("*")).alias("empty"),
    )


#: Most profile keys that are broadcast; with hash table about 64 bytes each.
BROADCAST_KEYS = 1 << 20


def with_profile(queries: DataFrame, table: DataFrame) -> DataFrame:
    """``queries`` (with float ``vec``) with ``pkey`` and the columns that ``table`` has for it.

    Many queries share a key, so keys are broadcast after a check of their number, and
    joined by a shuffle beyond ``BROADCAST_KEYS``.
    """
    known = stored(table)
    small = known.count() <= BROADCAST_KEYS
    return queries.withColumn("pkey", profile_key(quantize(F.col("vec")))).join(F.broadcast(known) if small else known.hint("shuffle_hash"), "pkey", "left")


def profile_verdicts(queries: DataFrame, table: DataFrame, min_count: int = 30) -> DataFrame:
    """``queries`` (with float ``vec``) with ``pkey`` and ``profile_count``: 0 or 5 where a pure key
    was seen often enough, else null. Only such keys are joined."""
    sure = table.where((F.col("cnt") >= min_count) & F.col("mask").isin(1, 2))
    return with_profile(queries, sure.select("pkey", F.when(F.col("mask") == 2, F.lit(5)).otherwise(F.lit(0)).alias("profile_count")))
