import numpy as np
from pyspark.sql import functions as F

from nearvote.functions.vector import partial_distance
from nearvote.operators import features, ivf


def test_partial_distance_of_extremes(spark):
    """Compiled, and no overflow of 32-bit integers."""
    df = spark.createDataFrame([([1, 32767, -32768], [1, -32768, 32767])], "a array<int>, b array<int>")
    got = df.select(partial_distance(F.col("a"), F.col("b"), 1, 2).alias("tail"), partial_distance(F.col("a"), F.col("b"), 0, 1).alias("head"))
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first() == (2 * 65535.0**2, 0.0)


def test_each_part_of_a_request_is_looked_up_once(spark):
    plan = features.parse_requests(spark.createDataFrame([(1, "{}")], "qid long, value string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("schema_of_variant(") <= len(features.PARTS)


def test_bounds_are_found_for_a_few_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    q, worst = rng.integers(-50, 50, (40, 4)).astype(float), np.where(rng.random(40) < 0.2, np.nan, rng.integers(0, 4000, 40))
    known = ivf.Clusters(np.array([0]), np.zeros((1, 4)), np.full((1, 4), -9.0), np.full((1, 4), 9.0), np.array([18.0]))
    whole = known.may_hold(0, q, worst)
    seen, inner = [], ivf.Clusters._may_hold
    monkeypatch.setattr(ivf, "BOUND_ROWS", 7)
    monkeypatch.setattr(ivf.Clusters, "_may_hold", lambda self, place, q, worst: seen.append(len(q)) or inner(self, place, q, worst))
    assert (known.may_hold(0, q, worst) == whole).all() and 0 < whole.sum() < 40 and max(seen) == 7


def test_a_scan_gives_k_rows_a_query_and_task(spark):
    """However many batches and clusters its members come in."""
    rng = np.random.default_rng(1)
    known = ivf.Clusters(np.arange(4, dtype=np.int32), np.zeros((4, 2)), np.full((4, 2), -99.0), np.full((4, 2), 99.0), np.full(4, 200.0))
    rows = [(i, 0, i % 4, [float(x) for x in v]) for i, v in enumerate(rng.integers(-99, 100, (800, 2)).tolist())]
    members = spark.createDataFrame(rows, "ref_id long, fraud int, cluster_id int, q array<double>").coalesce(1)
    qid, q = np.arange(10_000, 10_005), rng.integers(-99, 100, (5, 2)).astype(float)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = ivf.scan_clusters(members, known, (qid, q, np.tile(np.arange(4), (5, 1))), None, 2, 3, False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, *x) for i, at in zip(qid.tolist(), q) for x in sorted((sum((a - b) ** 2 for a, b in zip(at, v)), r) for r, _, _, v in rows)[:3]}
    assert len(got) == 15 and {(r["qid"], r["d"], r["ref_id"]) for r in got} == want
