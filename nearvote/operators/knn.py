"""Exact nearest neighbours and their vote.

The smaller side is broadcast, queries in blocks of a checked size, and measured by the numpy kernel:
a task keeps each query's best k so far, so no row per pair is ever made, and only those are
shuffled by query. Many pairs of few dimensions are not measured at all: ``cells`` prunes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.functions import scores
from nearvote.functions.vector import quantize, squared_distance
from nearvote.operators import cells, knn_kernel
from nearvote.sources.scratch import stored


def query_blocks(queries: DataFrame, dims: int, block_bytes: int) -> list[DataFrame]:
    """The queries in blocks of about ``block_bytes`` of vectors."""
    n = queries.count()
    parts = max(1, -(-n * (dims + 2) * 8 // block_bytes))
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by (d, ref_id), with ``rk`` from 1."""
    order = W.partitionBy("qid").orderBy("d", "ref_id")
    return pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def nearest(queries: DataFrame, references: DataFrame, k: int, dims: int, config: ScoringConfig = ScoringConfig(), exclude_self: bool = True) -> DataFrame:
    """(qid, ref_id, fraud, d, rk): exact k nearest references of every query.

    ``queries`` has (qid, qv), ``references`` (ref_id, vec, fraud). Ties go to the lower id.
    """
    if dims <= cells.MOST_DIMS:
        references = stored(references.select("ref_id", "vec", "fraud"))
        queries = stored(queries.select("qid", "qv"))
        if references.count() * queries.count() > cells.FROM_PAIRS:
            return cells.nearest(queries, cells.build(references, dims), k, exclude_self)
    return knn_kernel.nearest(queries, references, k, dims, config, exclude_self)


def vote(neighbours: DataFrame, k: int = 5) -> DataFrame:
    """(qid, fraud_count, approved, fraud_score) by the k nearest."""
    counted = neighbours.where(F.col("rk") <= k).groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count"))
    return verdict(counted)


def verdict(counted: DataFrame) -> DataFrame:
    c = F.col("fraud_count")
    return counted.withColumn("approved", scores.approved(c)).withColumn("fraud_score", scores.fraud_score(c))


def quantized(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, quantize(F.col(name)))


def rerank(candidates: DataFrame, queries: DataFrame, references: DataFrame, dims: int, k: int = 5) -> DataFrame:
    """(qid, ref_id, fraud, d, rk): the candidates' exact distances, the best k kept.

    Only the few candidates of each query move: they fetch their vectors by id.
    """
    exact = candidates.select("qid", "ref_id").join(references, "ref_id").join(queries, "qid")
    return ranked(exact.select("qid", "ref_id", "fraud", squared_distance(F.col("qv"), F.col("vec"), dims).alias("d")), k)


def skip_rerank(frauds: Column, found: Column, k: int = 5) -> Column:
    """Whether no choice of k among ``found`` candidates with ``frauds`` can change the verdict."""
    least = F.greatest(F.lit(0), frauds - (found - k))
    return (F.least(frauds, F.lit(k)) < 3) | (least >= 3)


def decide(candidates: DataFrame, queries: DataFrame, references: DataFrame, dims: int, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """(qid, fraud_count, path, ...) from fixed-point candidates: the exact rerank runs only where
    it can matter; elsewhere the first k in fixed-point order are counted."""
    k = config.neighbours
    candidates = stored(candidates)  # a few rows a query; counted, split and reranked
    seen = candidates.groupBy("qid").agg(F.sum("fraud").cast("int").alias("frauds"), F.count("*").cast("int").alias("found"), F.sum(F.when(F.col("rk") <= k, F.col("fraud")).otherwise(0)).cast("int").alias("first"))
    sure = F.lit(True) if not config.rerank else skip_rerank(F.col("frauds"), F.col("found"), k)
    split = seen.withColumn("sure", sure)
    skipped = split.where("sure").select("qid", F.col("first").alias("fraud_count"), F.lit("rerank_skip").alias("path"))
    open_ = candidates.join(split.where("not sure").select("qid"), "qid", "left_semi")
    exact = rerank(open_, queries, references, dims, k).groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count")).select("qid", "fraud_count", F.lit("rerank").alias("path"))
    return verdict(skipped.unionByName(exact))


Detector = Callable[[DataFrame], DataFrame]
