import gzip
import json

import pytest
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.operators import generate, knn
from nearvote.operators.features import featurize, parse_requests
from nearvote.operators.index import profile_table
from nearvote.sources import readers
from nearvote.sources.scratch import stored
from nearvote.streaming import append, scoring
from nearvote.streaming.warmup import warm_up


def test_references_from_gzip(spark, tmp_path):
    rows = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.25] * 14, "label": "legit"}, {"vector": [0.0] * 14}]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(rows, f)
    got = readers.read_references(spark, f"file://{tmp_path}/refs.json.gz").collect()
    assert sorted((r["vec"][0], r["fraud"]) for r in got) == [(0.0, 0), (0.25, 0), (0.5, 1)]


def test_payload_round_trip(spark, tmp_path):
    grid = generate.payload_grid(spark, 20)
    readers.write_payloads(grid, f"file://{tmp_path}/p")
    with open(tmp_path / "p" / "more.txt", "w") as f:
        f.write("{}\n\nabc\n")
    assert readers.read_payloads(spark, f"file://{tmp_path}/p").count() == 20
    assert readers.read_payloads(spark, f"file://{tmp_path}/p", 5).count() == 5


def test_test_set_keeps_requests_raw(spark, tmp_path):
    entries = [{"request": {"merchant": {"mcc": 5411}}, "expected_approved": True, "expected_fraud_score": 0.2}, {"request": {}, "expected_approved": False, "expected_fraud_score": 1.0}]
    (tmp_path / "t.json").write_text(json.dumps({"entries": entries}))
    got = readers.read_test_set(spark, f"file://{tmp_path}/t.json").orderBy("qid").collect()
    assert json.loads(got[0]["value"]) == {"merchant": {"mcc": 5411}}
    assert [(r["expected_approved"], r["expected_score"]) for r in got] == [(True, 0.2), (False, 1.0)]


def test_dimension_files(spark, tmp_path):
    (tmp_path / "mcc.json").write_text('{"5411": 0.15, "7995": 0.85}')
    assert readers.read_mcc_risk(spark, f"file://{tmp_path}/mcc.json") == {"5411": 0.15, "7995": 0.85}
    (tmp_path / "n.json").write_text('{"max_amount": 1}')
    with pytest.raises(KeyError):
        readers.read_normalization(spark, f"file://{tmp_path}/n.json")


def test_stream_scores_every_request(spark, tmp_path):
    grid = generate.payload_grid(spark, 10).select(F.col("i").alias("qid"), "value")
    grid.union(spark.createDataFrame([(99, "{broken")], "qid long, value string")).write.parquet(f"file://{tmp_path}/in")
    refs = spark.createDataFrame([(i, [i / 10.0] * 14, i % 2) for i in range(10)], "ref_id long, vec array<double>, fraud int")

    def detector(rows):
        return knn.vote(knn.nearest(rows, refs, 5, 14, exclude_self=False)).withColumn("path", F.lit("exact"))

    incoming = spark.readStream.schema("qid long, value string").parquet(f"file://{tmp_path}/in")
    got = {r["qid"]: r for r in scoring.run_once(spark, incoming, detector, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").collect()}
    assert len(got) == 11
    assert (got[99]["parse_ok"], got[99]["path"], got[99]["approved"]) == (False, "fallback", True)
    assert json.loads(got[99]["response"]) == {"approved": True, "fraud_score": 0.0}
    whole = scoring.score_requests(grid, detector)
    assert {r["qid"]: r["fraud_count"] for r in whole.collect()} == {k: r["fraud_count"] for k, r in got.items() if k != 99}


def test_append_stream_equals_the_batch(spark, tmp_path):
    """Scored rows and rejects of a stream in append mode, with and without the profile shortcut."""
    grid = generate.payload_grid(spark, 60).select(F.col("i").alias("qid"), "value")
    odd = spark.createDataFrame([(97, None), (98, "{broken"), (99, '{"id":"' + "x" * 5000 + '"}')], "qid long, value string")
    rows = grid.union(odd)
    rows.write.parquet(f"file://{tmp_path}/in")
    refs = spark.createDataFrame([(i, [(i * j % 11) / 10.0 for j in range(14)], i % 2) for i in range(50)], "ref_id long, vec array<double>, fraud int")

    def detector(some):
        return knn.vote(knn.nearest(some, refs, 5, 14, exclude_self=False)).withColumn("path", F.lit("exact"))

    keyed = featurize(parse_requests(grid)).select(F.col("qid").alias("ref_id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(1).alias("fraud"))
    profile = profile_table(stored(keyed).where("ref_id < 7"))
    want = {r["qid"]: tuple(r) for r in scoring.score_requests(rows, detector).collect()}
    for name, config in (("plain", ScoringConfig()), ("profile", ScoringConfig(profile=True, profile_min_count=1))):
        incoming = spark.readStream.schema("qid long, value string").parquet(f"file://{tmp_path}/in")
        out, rejects = f"file://{tmp_path}/{name}/out", f"file://{tmp_path}/{name}/rejects"
        running = append.start(incoming, refs, out, rejects, f"file://{tmp_path}/{name}/checkpoint", once=True, config=config, profile=profile, warm=2)
        for r in running:
            r.awaitTermination()
        assert [tuple(r) for r in spark.read.parquet(rejects).collect()] == [(99, 5009)]
        got = {r["qid"]: tuple(r) for r in spark.read.parquet(out).collect()}
        assert set(got) == set(want) - {99}
        fast = {q for q, r in got.items() if r[2] == "profile"}
        assert bool(fast) == (name == "profile") and all(got[q][3] == 5 for q in fast)
        assert all(got[q] == want[q] for q in got if q not in fast)
    batch = append.score_append(rows, refs)
    assert {r["qid"]: tuple(r) for r in batch.collect()} == want
    with pytest.raises(ValueError, match="micro-batches"):
        append.score_append(rows, refs, config=ScoringConfig(block_bytes=100))


def test_streamed_references_equal_the_whole_document(spark, tmp_path):
    """Spaced, broken over lines, in any order of keys, without a key, null, empty; gzipped or split."""
    rows = [{"vector": [(i * j % 97) / 97 for j in range(14)], "label": ("fraud", "legit", None)[i % 3]} for i in range(5000)]
    rows += [{"label": "fraud", "vector": [1] * 14}, {"label": "fraud"}, {"vector": []}, {}]
    whole = json.dumps(rows, indent=1)
    (tmp_path / "refs.json").write_text(whole)
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        f.write(json.dumps(rows))
    (tmp_path / "none.json").write_text("[\n]")
    want = sorted(map(str, readers.read_references(spark, f"file://{tmp_path}/refs.json", flat=False).collect()))
    assert len(want) == len(rows)
    for name in ("refs.json", "refs.json.gz"):
        assert sorted(map(str, readers.read_references(spark, f"file://{tmp_path}/{name}").collect())) == want
    assert readers.read_references(spark, f"file://{tmp_path}/none.json").count() == 0
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
        split = readers.read_references(spark, f"file://{tmp_path}/refs.json")
        assert split.rdd.getNumPartitions() > 3 and sorted(map(str, split.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "nested.json").write_text('[{"vector": [0.5], "more": {"a": 1}, "label": "fraud"}]')
    assert [tuple(r) for r in readers.read_references(spark, f"file://{tmp_path}/nested.json", flat=False).collect()] == [([0.5], 1)]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_references(spark, f"file://{tmp_path}/nested.json").collect()


def test_warm_up_scores_lines_skips_malformed_ones_and_fills(spark):
    refs = spark.createDataFrame([(i, [i / 10.0] * 14, i % 2) for i in range(10)], "ref_id long, vec array<double>, fraud int")
    scorer = append.AppendScorer(refs)
    seen = []

    def detector(vectors):
        seen.append(vectors.rdd.getNumPartitions())
        return scorer.detect(vectors)

    lines = generate.payload_grid(spark, 20).select("value").union(spark.createDataFrame([("{broken",), (None,)], "value string"))
    done = warm_up(spark, detector, lines, per_slot=10, slots=3)
    assert (done.scored, done.skipped, done.drawn, seen) == (20, 2, 10, [3, 3])
    assert warm_up(spark, detector, lines, per_slot=5, slots=2).drawn == 0
    assert warm_up(spark, detector, per_slot=4).drawn == 4 * spark.sparkContext.defaultParallelism
    assert warm_up(spark, detector, lines.limit(0), per_slot=1, slots=1).scored == 0
