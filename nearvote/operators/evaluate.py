"""Agreement with an oracle, rank percentiles, threshold sweeps, path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least profile counts that a sweep tries (fixed values).
THRESHOLDS = (1, 2, 3, 5, 7, 10, 12, 15, 20, 25, 30, 50)


def _paired(oracle: DataFrame, candidate: DataFrame) -> DataFrame:
    a = oracle.select("qid", F.col("approved").alias("o"), F.col("fraud_count").alias("oc"))
    return a.join(candidate.select("qid", F.col("approved").alias("c"), F.col("fraud_count").alias("cc")), "qid")


def agreement(oracle: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: how often two scorers agree. A false positive is an approval the candidate denies."""
    return _paired(oracle, candidate).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o") == F.col("c")).alias("agree"),
        F.count_if(F.col("o") != F.col("c")).alias("disagree"),
        F.count_if(F.col("o") & ~F.col("c")).alias("false_positives"),
        F.count_if(~F.col("o") & F.col("c")).alias("false_negatives"),
        F.count_if(F.col("oc") != F.col("cc")).alias("count_mismatches"),
        F.round(F.count_if(F.col("o") == F.col("c")) * 100.0 / F.count("*"), 4).alias("agree_pct"),
    )


def disagreements(oracle: DataFrame, candidate: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` queries by id on which the verdicts differ."""
    return _paired(oracle, candidate).where("o <> c").orderBy("qid").limit(limit).select("qid", F.col("oc").alias("oracle_count"), F.col("cc").alias("candidate_count"))


def percentiles(samples: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: n, mean, max and the samples at rank floor(n * p), from 0, in ascending order.

    Equal values are counted first, and ranks are running sums of counts over ranges of
    values: a coarse grid of quantiles splits the values, so no task sorts all of them.
    """
    rows = samples.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    counted = rows.groupBy("v").agg(F.count("*").alias("n"))
    bounds = sorted(set(rows.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005)))  # 63 numbers at most
    counted = counted.withColumn("part", sum(((F.col("v") > b).cast("int") for b in bounds), F.lit(0)))
    sums = counted.groupBy("part").agg(F.sum("n").alias("rows"))
    before = sums.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = counted.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    total = rows.agg(F.count("*").alias("total"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    ranks = upto.crossJoin(F.broadcast(total))  # one row
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("v"))).alias(f"p{int(round(p * 100))}") for p in shares]
    return ranks.groupBy().agg(F.max("total").alias("n"), F.max("mean").alias("mean"), *picks, F.max("most").alias("max"))


def threshold_sweep(scored: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(min_count, n, covered, correct, false_positives, false_negatives) for each threshold.

    ``scored`` has mask and cnt of a query's profile key (null: unseen), the searched
    verdict ``approved`` and the ``expected`` one.
    """
    values = scored.sparkSession.createDataFrame([(t,) for t in thresholds], "min_count int")
    sure = (F.col("cnt") >= F.col("min_count")) & F.col("mask").isin(1, 2)
    fast = F.coalesce(sure, F.lit(False))
    final = F.when(fast, F.col("mask") == 1).otherwise(F.col("approved"))
    rows = scored.crossJoin(F.broadcast(values)).select("min_count", fast.alias("fast"), final.alias("final"), "expected")
    return rows.groupBy("min_count").agg(
        F.count("*").alias("n"),
        F.count_if("fast").alias("covered"),
        F.count_if(F.col("final") == F.col("expected")).alias("correct"),
        F.count_if(F.col("expected") & ~F.col("final")).alias("false_positives"),
        F.count_if(~F.col("expected") & F.col("final")).alias("false_negatives"),
    )


def path_counts(verdicts: DataFrame) -> DataFrame:
    """(path, n, denied) of a scorer's result."""
    return verdicts.groupBy("path").agg(F.count("*").alias("n"), F.count_if(~F.col("approved")).alias("denied"))
