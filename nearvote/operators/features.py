"""Requests to feature vectors: JSON parsing with its edge cases, and the 14 features."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.config import DEFAULT_RISK, MCC_RISK, Normalization
from nearvote.functions.scores import round4, share

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")
#: The parts of a request document that are read.
PARTS = (
    "$.transaction.amount",
    "$.transaction.installments",
    "$.transaction.requested_at",
    "$.customer.avg_amount",
    "$.customer.tx_count_24h",
    "$.customer.known_merchants",
    "$.merchant.id",
    "$.merchant.mcc",
    "$.merchant.avg_amount",
    "$.terminal.is_online",
    "$.terminal.card_present",
    "$.terminal.km_from_home",
    "$.last_transaction",
    "$.last_transaction.timestamp",
    "$.last_transaction.km_from_current",
)


def parse_requests(raw: DataFrame, value: str = "value", max_body: int | None = None) -> DataFrame:
    """``raw`` with ``request`` (a struct as in schema.REQUEST) and ``parse_ok``.

    A body that is no JSON document, is longer than ``max_body``, has a fractional count or
    has only one of its two timestamps readable is not ok: its request is null, and scoring
    falls back to approval. Numbers given as strings count as 0, a category given as a
    number as unknown, and timestamps use their first 19 characters.
    """
    # Each part of a document is looked up once, and so is its kind: everything else reads these columns.
    part, of = {path: f"_part{i}" for i, path in enumerate(PARTS)}, {path: f"_kind{i}" for i, path in enumerate(PARTS)}

    def kind(path: str) -> Column:
        return F.col(of[path])

    def read(path: str, as_type: str) -> Column:
        return F.try_variant_get(part[path], "$", as_type)

    def numeric(path: str) -> Column:
        return kind(path).isin(*NUMBERS) | kind(path).startswith("DECIMAL")

    def number(path: str) -> Column:
        return F.when(numeric(path), read(path, "double")).otherwise(F.lit(0.0))

    def whole(path: str) -> Column:
        return F.when(kind(path) == "BIGINT", read(path, "int")).otherwise(F.lit(0))

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", read(path, "string"))

    def flag(path: str) -> Column:
        return F.when(kind(path) == "BOOLEAN", read(path, "boolean")).otherwise(F.lit(False))

    def moment(path: str) -> Column:
        return F.when(F.length(text(path)) >= 19, F.substr(text(path), F.lit(1), F.lit(19)).try_cast("timestamp_ntz"))

    counts = ("$.transaction.installments", "$.customer.tx_count_24h")
    fractional = F.lit(False)
    for path in counts:
        fractional = fractional | F.coalesce(numeric(path) & ((kind(path) != "BIGINT") | read(path, "int").isNull()), F.lit(False))
    has_last = F.coalesce(kind("$.last_transaction").startswith("OBJECT"), F.lit(False))
    requested, last = F.col("_requested"), F.col("_last")
    ok = F.col("_json").isNotNull() & ~fractional & ~(has_last & (requested.isNull() != last.isNull()))
    if max_body is not None:
        ok = ok & (F.octet_length(value) <= max_body)
    request = F.struct(
        number("$.transaction.amount").alias("amount"),
        whole(counts[0]).alias("installments"),
        requested.alias("requested_at"),
        number("$.customer.avg_amount").alias("avg_amount"),
        whole(counts[1]).alias("tx_count_24h"),
        read("$.customer.known_merchants", "array<string>").alias("known_merchants"),
        text("$.merchant.id").alias("merchant_id"),
        text("$.merchant.mcc").alias("mcc"),
        number("$.merchant.avg_amount").alias("merchant_avg"),
        flag("$.terminal.is_online").alias("is_online"),
        flag("$.terminal.card_present").alias("card_present"),
        number("$.terminal.km_from_home").alias("km_from_home"),
        has_last.alias("has_last"),
        last.alias("last_at"),
        number("$.last_transaction.km_from_current").alias("last_km"),
    )
    looked = raw.withColumn("_json", F.try_parse_json(F.col(value))).withColumns({part[path]: F.try_variant_get("_json", path, "variant") for path in PARTS})
    told = looked.withColumns({of[path]: F.schema_of_variant(part[path]) for path in PARTS})
    timed = told.withColumns({"_requested": moment("$.transaction.requested_at"), "_last": moment("$.last_transaction.timestamp")})
    parsed = timed.withColumn("parse_ok", F.coalesce(ok, F.lit(False)))
    return parsed.withColumn("request", F.when(F.col("parse_ok"), request)).drop("_json", "_requested", "_last", *part.values(), *of.values())


def risk(mcc: Column, table: dict[str, float] | None = None, default: float = DEFAULT_RISK) -> Column:
    """Risk of a merchant category; unknown, malformed and out-of-range ones get the default."""
    table = MCC_RISK if table is None else table
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable((int(k), float(v)) for k, v in sorted(table.items()))))
    return F.coalesce(known[mcc.try_cast("int")], F.lit(default))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def features(r: str | Column = "request", norm: Normalization = Normalization(), risks: dict[str, float] | None = None) -> Column:
    """array<float> of the 14 features of a request struct; -1 twice without a last transaction.

    A request without a readable timestamp has hour 0 and weekday 2, as a zero date would.
    """
    col = F.col(r) if isinstance(r, str) else r

    def f(name: str) -> Column:
        return col.getField(name)

    ratio = F.when(f("avg_amount") == 0, F.lit(1.0)).otherwise(share(f("amount") / f("avg_amount"), norm.amount_vs_avg_ratio))
    hour = F.coalesce(F.hour(f("requested_at")), F.lit(0))
    day = F.coalesce(F.weekday(f("requested_at")), F.lit(2))
    minutes = F.coalesce(seconds_between(f("requested_at"), f("last_at")) / F.lit(60.0), F.lit(0.0))
    missing = ~F.coalesce(f("has_last"), F.lit(False))
    known = F.array_contains(F.slice(F.coalesce(f("known_merchants"), F.array().cast("array<string>")), 1, 32), F.coalesce(f("merchant_id"), F.lit("")))
    values = [
        share(f("amount"), norm.max_amount),
        share(f("installments"), norm.max_installments),
        ratio,
        round4(hour / F.lit(23.0)),
        round4(day / F.lit(6.0)),
        F.when(missing, F.lit(-1.0)).otherwise(share(minutes, norm.max_minutes)),
        F.when(missing, F.lit(-1.0)).otherwise(share(f("last_km"), norm.max_km)),
        share(f("km_from_home"), norm.max_km),
        share(f("tx_count_24h"), norm.max_tx_count_24h),
        f("is_online").cast("int"),
        f("card_present").cast("int"),
        (~F.coalesce(known, F.lit(False))).cast("int"),
        risk(f("mcc"), risks),
        share(f("merchant_avg"), norm.max_merchant_avg_amount),
    ]
    return F.array(*(v.cast("float") for v in values))


def featurize(requests: DataFrame, norm: Normalization = Normalization(), risks: dict[str, float] | None = None) -> DataFrame:
    """``requests`` with ``vec``; null where the request is."""
    return requests.withColumn("vec", F.when(F.col("request").isNotNull(), features("request", norm, risks)))
