"""Command line: build an index, compare it with an exact one, write payloads, time, sweep.

    python -m nearvote preprocess references.json.gz index [--k 4096] [--iterations 20] [--format ivf] [--nprobe 5]
    python -m nearvote accuracy index exact_index [--count 10000] [--seed 195842629]
    python -m nearvote payloads out [--count 200]
    python -m nearvote timing index payloads [--count 5000] [--mcc-risk FILE] [--normalization FILE]
    python -m nearvote sweep index test-set.json [--mcc-risk FILE] [--normalization FILE]
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.config import DIMS, Normalization
from nearvote.functions.vector import profile_key, quantize
from nearvote.operators import evaluate, generate
from nearvote.operators.features import featurize, parse_requests
from nearvote.operators.ivf import SearchStats
from nearvote.sources import readers
from nearvote.sources.index_store import open_index, write_index


def preprocess(spark: SparkSession, source: str, out: str, k: int, iterations: int, kind: str, nprobe: int) -> int:
    """Read a labelled reference file, number its rows and write an index of it."""
    rows = readers.read_references(spark, source).withColumn("ref_id", F.monotonically_increasing_id())
    # A gzipped file is one task: spread the rows before the index is built from them.
    rows.write.mode("overwrite").parquet(f"{out}/references")
    write_index(spark.read.parquet(f"{out}/references"), out, kind, DIMS, k, iterations, nprobe)
    return 0


def accuracy(spark: SparkSession, index: str, exact: str, count: int, seed: int) -> DataFrame:
    """Agreement of an index with an exact one over drawn query vectors."""
    queries = generate.query_vectors(spark, count, seed).persist()
    return evaluate.agreement(open_index(spark, exact).score(queries), open_index(spark, index).score(queries))


def _constants(spark: SparkSession, mcc_risk: str | None, normalization: str | None) -> tuple[Normalization, dict[str, float] | None]:
    """Constants and category risks of the files given, else the built-in ones."""
    norm = readers.read_normalization(spark, normalization) if normalization else Normalization()
    return norm, readers.read_mcc_risk(spark, mcc_risk) if mcc_risk else None


def timing(spark: SparkSession, index: str, payloads: str, count: int, mcc_risk: str | None = None, normalization: str | None = None) -> dict[str, float]:
    """Seconds to parse and to score the payloads; for an inverted file also those of the search's
    stages and its (query, cluster) pairs probed, repaired and pruned."""
    raw = readers.read_payloads(spark, payloads, count).withColumn("qid", F.monotonically_increasing_id())
    constants = _constants(spark, mcc_risk, normalization)
    began = time.perf_counter()
    ready = featurize(parse_requests(raw), *constants).where("vec is not null").select("qid", F.col("vec").cast("array<double>").alias("qv")).persist()
    n = ready.count()
    parsed = time.perf_counter()
    stats = SearchStats()
    open_index(spark, index).score(ready, stats=stats).write.format("noop").mode("overwrite").save()
    scored = time.perf_counter()
    return {"rows": n, "parse_s": parsed - began, "score_s": scored - parsed, "rows_per_s": n / (scored - began)} | {f"{k}_s": v for k, v in stats.seconds.items()} | {"probed": stats.probed, "repaired": stats.repaired, "pruned": stats.pruned}


def sweep(spark: SparkSession, index: str, tests: str, mcc_risk: str | None = None, normalization: str | None = None) -> DataFrame:
    """Coverage and accuracy of the profile shortcut over a labelled test set."""
    opened = open_index(spark, index)
    if opened.profile is None:
        raise ValueError(f"{index} has no profile table")
    entries = readers.read_test_set(spark, tests)
    ready = featurize(parse_requests(entries), *_constants(spark, mcc_risk, normalization)).where("vec is not null").select("qid", "expected_approved", F.col("vec").cast("array<double>").alias("qv")).persist()
    verdicts = opened.score(ready.select("qid", "qv")).select("qid", "approved")
    keyed = ready.withColumn("pkey", profile_key(quantize(F.col("qv")))).join(opened.profile, "pkey", "left").join(verdicts, "qid")
    return evaluate.threshold_sweep(keyed.select("mask", "cnt", "approved", F.col("expected_approved").alias("expected"))).orderBy("min_count")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearvote")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preprocess")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--k", type=int, default=4096)
    p.add_argument("--iterations", type=int, default=20)
    p.add_argument("--format", dest="kind", default="ivf")
    p.add_argument("--nprobe", type=int, default=5)
    p = commands.add_parser("accuracy")
    p.add_argument("index")
    p.add_argument("exact")
    p.add_argument("--count", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=195842629)
    p = commands.add_parser("payloads")
    p.add_argument("out")
    p.add_argument("--count", type=int, default=200)
    p = commands.add_parser("timing")
    p.add_argument("index")
    p.add_argument("payloads")
    p.add_argument("--count", type=int, default=5000)
    p = commands.add_parser("sweep")
    p.add_argument("index")
    p.add_argument("tests")
    for name in ("timing", "sweep"):
        commands.choices[name].add_argument("--mcc-risk")
        commands.choices[name].add_argument("--normalization")
    given = vars(parser.parse_args(args))
    command = given.pop("command")
    spark = spark or SparkSession.builder.appName("nearvote").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command == "preprocess":
        return preprocess(spark, **given)
    if command == "accuracy":
        report = accuracy(spark, **given)
        report.show(truncate=False)
        return int(report.first()["disagree"] > 0)
    if command == "payloads":
        readers.write_payloads(generate.payload_grid(spark, given["count"]), given["out"])
    elif command == "timing":
        print(timing(spark, **given))
    else:
        sweep(spark, **given).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
