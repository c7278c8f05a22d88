"""Corpus pipeline: toxicity, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's
result as Parquet in the shared folder and hands it to the next. All stages but the last
return the columns of ``documents``. Other columns pass through unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import common
from nearvote.llm.decontamination import decontaminate
from nearvote.llm.ngram_join import ngram_jaccard_join
from nearvote.llm.packing import pack
from nearvote.llm.secrets import redact
from nearvote.llm.toxicity import ToxicityConfig, sample, score, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the factorization machine, learnt from ``labels``.

    Every row is judged by its text alone, so null and repeated ids and equal rows don't matter.
    A null or empty text has the base rate of the labels. Without labels of both kinds nothing
    is dropped unless all labels are toxic; an empty table stays empty.
    """
    config = ToxicityConfig()
    out = common.fresh(docs.columns, "toxicity")
    model = train(sample(docs, _table(spark, sf_dir, "labels"), config, "doc_id", "text", "toxic", None), config)
    return score(docs, model, config, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group linked by a Jaccard similarity of 0.8 or
    more of five-word shingles.

    Rows without words all stay. Where ids are null or repeat, rows are told apart by a number of
    their own; a null id comes after all others, and of rows with one id the first stored
    stays, so of equal rows one stays here too.
    """
    key = "doc_id"
    if docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        kept = ngram_jaccard_join(docs, k=5, percent=80, id_col=key).where("component_id = doc_id").select(F.col("doc_id").alias(key))
        return docs.join(kept, key, "left_semi").select(*docs.columns)
    number = common.fresh(docs.columns, "number")
    # Stored, so that the numbers last; no sort brings null ids together.
    numbered = common.store(docs.withColumn(number, F.monotonically_increasing_id()), f"{common.shared_dir(spark)}/numbered")
    groups = ngram_jaccard_join(numbered, k=5, percent=80, id_col=number)
    ids = numbered.select(F.col(number).alias("at"), F.col(key).alias("id"))
    owner = groups.join(ids, groups["doc_id"] == ids["at"]).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("kept"))
    kept = owner.select(F.col("kept.at").alias(number))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is 0.8 similar or more to a benchmark item.

    Every row is judged by its own text: null and repeated ids and equal rows don't matter. Rows
    without words stay; an empty benchmark drops nothing.
    """
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars`` follows the text.

    All rows stay, equal ones too; a null text and its ``n_chars`` stay as they are.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document that is left.

    A null text has no words; rows that repeat an id, or have none, get slots of their own.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("packing", pack_batches),
]

#: The first stage's model and the packing's dynamic program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, before = common.shared_dir(spark), None
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), f"{path}/{name}")
        if before:  # nothing reads a stage's table once the next one is written
            common.remove(spark, before)
        before = f"{path}/{name}"
    return docs
