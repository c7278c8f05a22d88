"""Synthetic inputs: the payload grid and hash-based query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the payload grid.
AMOUNTS = (10.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 50000.0)
INSTALLMENTS = (1, 3, 6, 12)
CATEGORIES = ("5411", "5812", "5814", "5912", "5921", "5942", "6011", "7011", "7995", "4121")
KMS = (0.2, 1.5, 5.0, 25.0, 200.0)
COUNTS = (0, 1, 3, 10, 50)
FLAGS = ((True, True), (True, False), (False, True), (False, False))
KNOWN = ((), ("m-001",), ("m-001", "m-002"), ("m-001", "m-002", "m-003", "m-004", "m-005"))
MERCHANT = "m-001"
REQUESTED_AT, LAST_AT = "2026-04-15T13:42:11Z", "2026-04-15T11:10:00Z"


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def _money(x: Column) -> Column:
    """Two decimals as a number that JSON writes the same way."""
    return F.round(x, 2)


def payload_grid(spark: SparkSession, count: int = 200) -> DataFrame:
    """(i, value): the first ``count`` of amounts x categories x kilometres, as request documents."""
    each = len(CATEGORIES) * len(KMS)
    grid = spark.range(min(count, len(AMOUNTS) * each)).select(F.col("id").alias("i"))
    i = F.col("i")
    amount, km = _pick(AMOUNTS, F.expr(f"i div {each}")), _pick(KMS, i)
    category = _pick(CATEGORIES, F.expr(f"i div {len(KMS)}"))
    online = _pick(tuple(a for a, _ in FLAGS), i)
    card = _pick(tuple(b for _, b in FLAGS), i)
    known = F.element_at(F.array(*(F.array(*(F.lit(m) for m in names)).cast("array<string>") for names in KNOWN)), (i % len(KNOWN) + 1).cast("int"))
    body = F.struct(
        F.concat(F.lit("warm-tx-"), i + 1).alias("id"),
        F.struct(_money(amount).alias("amount"), _pick(INSTALLMENTS, i).alias("installments"), F.lit(REQUESTED_AT).alias("requested_at")).alias("transaction"),
        F.struct(_money(amount / 1.5).alias("avg_amount"), _pick(COUNTS, i).alias("tx_count_24h"), known.alias("known_merchants")).alias("customer"),
        F.struct(F.lit(MERCHANT).alias("id"), category.alias("mcc"), _money(amount * 0.9).alias("avg_amount")).alias("merchant"),
        F.struct(online.alias("is_online"), card.alias("card_present"), _money(km).alias("km_from_home")).alias("terminal"),
        F.struct(F.lit(LAST_AT).alias("timestamp"), _money(km / 2).alias("km_from_current")).alias("last_transaction"),
    )
    return grid.select("i", F.to_json(body).alias("value"))


def query_vectors(spark: SparkSession, count: int, seed: int = 0, dims: int = 14, missing: float = 0.05) -> DataFrame:
    """(qid, qv): uniform vectors drawn by hashing; a share of them has no last transaction."""
    rows = spark.range(count).select(F.col("id").alias("qid"))

    def draw(i: int) -> Column:
        return (F.pmod(F.xxhash64("qid", F.lit(seed), F.lit(i)), F.lit(1 << 53)).cast("double") / float(1 << 53)).cast("float").cast("double")

    none = draw(dims) < missing
    values = [F.when(none, F.lit(-1.0)).otherwise(draw(i)) if i in (5, 6) else draw(i) for i in range(dims)]
    return rows.select("qid", F.array(*values).alias("qv"))
