"""Scans of requests, labelled references, test sets and dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.config import Normalization
from nearvote.schema import LABELLED_JSON


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_references(spark: SparkSession, path: str, flat: bool = True) -> DataFrame:
    """(vec, fraud) of a JSON array of {vector, label}, gzipped or not.

    Objects without nested ones are read as records that end with a brace: they stream out of the
    decompressor, so no task holds the document, and a file that is not compressed is split over
    tasks. A record that can't be read that way is an error, never dropped: ``flat=False`` reads
    nested objects and braces within strings, each file whole in one task.
    """
    if flat:
        records = spark.read.option("lineSep", "}").text(path).where(F.contains("value", F.lit("{")))
        document = F.concat(F.regexp_replace("value", r"^[^{]*", ""), F.lit("}"))
        rows = records.select(F.from_json(document, LABELLED_JSON, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    else:
        rows = spark.read.schema(LABELLED_JSON).option("multiLine", True).json(path)
    return rows.select(F.col("vector").cast("array<double>").alias("vec"), F.coalesce((F.col("label") == "fraud").cast("int"), F.lit(0)).alias("fraud"))


def read_payloads(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(value): lines of at least four characters; at most ``limit`` of them if given."""
    lines = spark.read.text(path).where(F.length("value") >= 4)
    return lines if limit is None else lines.limit(limit)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """(qid, value, expected_approved, expected_score) of {entries: [...]}; requests stay JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    entries = whole.select(F.posexplode(F.try_variant_get("doc", "$.entries", "array<variant>")).alias("qid", "entry"))
    return entries.select(
        F.col("qid").cast("long").alias("qid"),
        F.to_json(F.try_variant_get("entry", "$.request", "variant")).alias("value"),
        F.try_variant_get("entry", "$.expected_approved", "boolean").alias("expected_approved"),
        F.try_variant_get("entry", "$.expected_fraud_score", "double").alias("expected_score"),
    )


def read_mcc_risk(spark: SparkSession, path: str) -> dict[str, float]:
    """Category risks of a JSON object, at most one entry per category."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("mcc", "risk"))
    return {r["mcc"]: r["risk"] for r in rows.collect() if 0 <= int(r["mcc"]) <= 9999}


def read_normalization(spark: SparkSession, path: str) -> Normalization:
    """The constants of a JSON object; all seven are required."""
    return Normalization.parse(spark.read.text(path, wholetext=True).first()["value"])


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON document per line."""
    payloads.select("value").write.mode("overwrite").text(path)
