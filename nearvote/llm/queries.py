"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm.decontamination import contaminated
from nearvote.llm.exact_topk import exact_top_k
from nearvote.llm.hard_negatives import hard_negatives
from nearvote.llm.language import identify_languages
from nearvote.llm.licenses import scan_licenses
from nearvote.llm.ngram_join import ngram_jaccard_join
from nearvote.llm.packing import pack
from nearvote.llm.ppm import score_texts
from nearvote.llm.ranked_search import rank_documents
from nearvote.llm.secrets import secret_digest
from nearvote.llm.sharding import assign_shards
from nearvote.llm.sql import SQL
from nearvote.llm.tiff import media_digest
from nearvote.llm.toxicity import toxicity


__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents: 4-word shingles, Jaccard of 85 % or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed patterns and the randomness battery."""
    return secret_digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 optimal length buckets and batches of 16,384 padded words."""
    return pack(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF pages, read back and digested."""
    return media_digest(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump-hash shards 0 to 7 of all documents, and where they go with a ninth."""
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents and their lines against known licences."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a factorization machine over hashed terms."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by Viterbi over per-word scores."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs whose best window is 0.8 similar or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents by prediction by partial matching."""
    return score_texts(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item by a bit-sliced impact index."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector by term-at-a-time accumulation."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector and its positives by inverted lists with radii."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scans": op2_secret_scans,
    "op3_packing": op3_packing,
    "op4_media_columns": op4_media_columns,
    "op5_sharding": op5_sharding,
    "op6_license_scans": op6_license_scans,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_topk": op12_exact_topk,
    "op13_hard_negatives": op13_hard_negatives,
}
