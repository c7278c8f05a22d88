"""How the driver's tables stand in for requests, references and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.functions.vector import quantize
from nearvote.operators import kmeans
from nearvote.operators.index import cluster_stats
from nearvote.sources.readers import table

DIMS = 64
CLUSTERS = 16
#: Event types as merchants: their category codes.
EVENT_MCC = (("signup", "5411"), ("view", "5812"), ("purchase", "7995"), ("error", "7801"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """(ref_id, vec, fraud) of the embeddings; labels 5 to 9 count as fraud."""
    emb = table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("ref_id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") >= 5).cast("int").alias("fraud"))


def queries(refs: DataFrame) -> DataFrame:
    """(qid, qv): every tenth reference; searches leave the row itself out."""
    return refs.where("ref_id % 10 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))


def fixed(refs: DataFrame) -> DataFrame:
    return refs.select("ref_id", quantize(F.col("vec")).alias("vec"), "fraud")


def fixed_queries(refs: DataFrame) -> DataFrame:
    return fixed(refs).where("ref_id % 10 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))


def one_step(refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centroids, assigned, clusters) of the seeds and one assignment: deterministic everywhere."""
    centroids = fetched(kmeans.seeds(refs, CLUSTERS).select("cluster_id", "centroid"))
    assigned = kmeans.assign(refs, centroids, DIMS)
    return centroids, assigned, fetched(cluster_stats(assigned, centroids, DIMS))


def fetched(per_cluster: DataFrame) -> DataFrame:
    """A table of one row per cluster, computed now instead of in every plan that uses it."""
    return per_cluster.sparkSession.createDataFrame(per_cluster.collect(), per_cluster.schema)


def members(assigned: DataFrame) -> DataFrame:
    return assigned.select("ref_id", "fraud", "cluster_id", quantize(F.col("vec")).alias("q"))


def event_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, fraud, request) of the events: users are customers, event types merchants."""
    e = table(spark, sf, "events").withColumn("amount", F.abs(F.coalesce("value", F.lit(0.0))))
    users = e.groupBy("user_id").agg(F.round(F.avg("amount"), 6).alias("avg_amount"), F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))).alias("known"))
    kinds = e.groupBy("event_type").agg(F.round(F.avg("amount"), 6).alias("merchant_avg"))
    per_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    day = W.partitionBy("user_id").orderBy(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))).rangeBetween(-86_400_000_000, 0)
    rows = e.withColumn("last_at", F.lag("ts").over(per_user)).withColumn("count24", F.count("*").over(day).cast("int"))
    mcc = F.lit(None).cast("string")
    for kind, code in EVENT_MCC:
        mcc = F.when(F.col("event_type") == kind, F.lit(code)).otherwise(mcc)
    rows = rows.join(users, "user_id").join(kinds, "event_type")
    request = F.struct(
        F.col("amount"),
        (F.col("event_id") % 12 + 1).cast("int").alias("installments"),
        _second(F.col("ts")).alias("requested_at"),
        F.col("avg_amount"),
        F.col("count24").alias("tx_count_24h"),
        F.col("known").alias("known_merchants"),
        F.col("event_type").alias("merchant_id"),
        mcc.alias("mcc"),
        F.col("merchant_avg"),
        (F.col("event_id") % 2 == 0).alias("is_online"),
        (F.col("event_id") % 3 == 0).alias("card_present"),
        (F.col("event_id") % 500).cast("double").alias("km_from_home"),
        F.col("last_at").isNotNull().alias("has_last"),
        _second(F.col("last_at")).alias("last_at"),
        ((F.col("event_id") % 97) * 1.5).cast("double").alias("last_km"),
    )
    return rows.select("event_id", (F.col("event_id") % 7 == 0).cast("int").alias("fraud"), request.alias("request"))


def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, value): the events' requests as JSON documents."""
    r = event_requests(spark, sf).select("event_id", "request.*")

    def stamp(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    body = F.struct(
        F.concat(F.lit("tx-"), F.col("event_id")).alias("id"),
        F.struct("amount", "installments", stamp("requested_at").alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        F.when(F.col("has_last"), F.struct(stamp("last_at").alias("timestamp"), F.col("last_km").alias("km_from_current"))).alias("last_transaction"),
    )
    return r.select("event_id", F.to_json(body).alias("value"))


#: How ``odd_payloads`` changes the document of each event: by event_id % 11, other ones stay.
#: (case, pattern, replacement); a null pattern cuts the document in half.
ODD = (
    ("numeric_category", r'"mcc":"([0-9]+)"', '"mcc":$1'),
    ("spaced_category", r'"mcc":"([0-9]+)"', '"mcc":" +$1 "'),
    ("long_category", r'"mcc":"([0-9]+)"', '"mcc":"12$1"'),
    ("text_amount", r'^(.*?"amount":)([^,]*)', '$1"$2"'),
    ("fractional_count", r'"installments":([0-9]+)', '"installments":$1.5'),
    ("short_stamp", r'"requested_at":"([0-9-]{10})[^"]*"', '"requested_at":"$1"'),
    ("no_terminal", r',"terminal":\{[^}]*\}', ""),
    ("zero_average", r'"avg_amount":[^,]*,"tx', '"avg_amount":0,"tx'),
    ("text_flag", r'"is_online":(true|false)', '"is_online":"$1"'),
    ("cut", None, None),
)


def odd_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, case, value): ``event_payloads``, most of them changed as ``ODD`` tells."""
    case, value = F.lit("plain"), F.col("value")
    for i, (name, pattern, new) in enumerate(ODD):
        own = F.col("event_id") % 11 == i
        case = F.when(own, F.lit(name)).otherwise(case)
        half = F.left("value", (F.length("value") / 2).cast("int"))
        value = F.when(own, half if pattern is None else F.regexp_replace("value", pattern, new)).otherwise(value)
    return event_payloads(spark, sf).select("event_id", case.alias("case"), value.alias("value"))


def order_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, value): a document of fixed shape per order, with its price as the amount, its key
    modulo 24 as installments and its date, at a fixed time, as the moment."""
    parts = (
        F.lit('{"id":"o","transaction":{"amount":'),
        F.col("o_totalprice"),
        F.lit(',"installments":'),
        F.col("o_orderkey") % 24,
        F.lit(',"requested_at":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('T21:07:45Z"},"customer":{"avg_amount":64000.5,"tx_count_24h":4,"known_merchants":["m-7","m-9"]},"merchant":{"id":"m-9","mcc":"5944","avg_amount":812.25},"terminal":{"is_online":false,"card_present":true,"km_from_home":37.5},"last_transaction":{"timestamp":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('T19:52:30Z","km_from_current":12.75}}'),
    )
    return table(spark, sf, "orders").select("o_orderkey", F.concat(*parts).alias("value"))


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, request): orders with their customer's history and their first supplier."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("installments"), F.min("l_suppkey").alias("supplier"), F.round(F.avg("l_extendedprice"), 2).alias("merchant_avg"))
    customers = orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("avg_amount"), F.count("*").cast("int").alias("orders"))
    joined = orders.join(per_order, "o_orderkey").join(customers, "o_custkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    last = F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = joined.withColumn("last_at", last)
    request = F.struct(
        F.col("o_totalprice").alias("amount"),
        F.col("installments"),
        _second(F.col("o_orderdate")).alias("requested_at"),
        F.col("avg_amount"),
        F.col("orders").alias("tx_count_24h"),
        F.array(F.lit("m-1"), F.lit("m-2"), F.concat(F.lit("m-"), (F.col("o_custkey") % 10).cast("string"))).alias("known_merchants"),
        F.concat(F.lit("m-"), (F.col("supplier") % 10).cast("string")).alias("merchant_id"),
        F.when(F.col("supplier") % 2 == 0, F.lit("5411")).when(F.col("supplier") % 5 == 0, F.lit("9999")).otherwise(F.lit("7995")).alias("mcc"),
        F.col("merchant_avg"),
        (F.col("o_orderstatus") == "O").alias("is_online"),
        (F.col("o_orderstatus") == "F").alias("card_present"),
        (F.col("c_nationkey") * 40).cast("double").alias("km_from_home"),
        F.col("last_at").isNotNull().alias("has_last"),
        _second(F.col("last_at")).alias("last_at"),
        (F.col("supplier") % 700).cast("double").alias("last_km"),
    )
    return rows.select("o_orderkey", request.alias("request"))


def _second(ts: Column) -> Column:
    return F.date_trunc("second", ts).cast("timestamp_ntz")
