"""Explicit schemas of requests, references and verdicts."""

from pyspark.sql import types as T

REQUEST = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("installments", T.IntegerType()),
        T.StructField("requested_at", T.TimestampNTZType()),
        T.StructField("avg_amount", T.DoubleType()),
        T.StructField("tx_count_24h", T.IntegerType()),
        T.StructField("known_merchants", T.ArrayType(T.StringType())),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("merchant_avg", T.DoubleType()),
        T.StructField("is_online", T.BooleanType()),
        T.StructField("card_present", T.BooleanType()),
        T.StructField("km_from_home", T.DoubleType()),
        T.StructField("has_last", T.BooleanType()),
        T.StructField("last_at", T.TimestampNTZType()),
        T.StructField("last_km", T.DoubleType()),
    ]
)
REFERENCE = T.StructType([T.StructField("ref_id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("fraud", T.IntegerType())])
LABELLED_JSON = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType())])
