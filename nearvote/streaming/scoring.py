"""Scoring a stream of request documents.

Every row is scored by itself, so the stream has no state and no watermark. Searching
needs a ranking, which streams don't allow, so each micro-batch is scored as a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearvote.config import Normalization, ScoringConfig
from nearvote.functions import scores
from nearvote.operators.features import featurize, parse_requests
from nearvote.sources.scratch import stored


def score_requests(raw: DataFrame, detector: Callable[[DataFrame], DataFrame], norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None) -> DataFrame:
    """(qid, parse_ok, path, fraud_count, approved, response) of every (qid, value) row.

    A request that cannot be parsed is approved with score 0; none is dropped.
    ``detector`` maps (qid, qv) to (qid, fraud_count, path, ...). ``norm`` and ``risks``:
    constants and category risks as ``readers`` load them.
    """
    # Stored, since it is read twice: a filter of the vectors would parse the documents again and again.
    ready = stored(featurize(parse_requests(raw, "value", config.max_body), norm, risks).select("qid", "parse_ok", F.col("vec").cast("array<double>").alias("qv")))
    found = detector(ready.where("qv is not null").select("qid", "qv")).select("qid", "fraud_count", "path")
    joined = ready.select("qid", "parse_ok").join(found, "qid", "left")
    count = F.coalesce("fraud_count", F.lit(0))
    return joined.select("qid", "parse_ok", F.coalesce("path", F.lit("fallback")).alias("path"), count.alias("fraud_count"), scores.approved(count).alias("approved"), scores.response(count).alias("response"))


def start(requests: DataFrame, detector: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None) -> StreamingQuery:
    """Score the streaming (qid, value) rows; ``sink`` gets each scored micro-batch and its number."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(score_requests(rows, detector, norm, config, risks), number)

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_once(spark: SparkSession, requests: DataFrame, detector: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, norm: Normalization = Normalization(), config: ScoringConfig = ScoringConfig(), risks: dict[str, float] | None = None) -> DataFrame:
    """Score all that is there now, as a stream, into Parquet; returns what is in it."""

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = start(requests, detector, sink, checkpoint, True, norm, config, risks)
    query.awaitTermination()
    return spark.read.parquet(out)
