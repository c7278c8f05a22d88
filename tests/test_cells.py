import numpy as np
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.operators import cells, knn, knn_kernel
from nearvote.streaming import append

DIMS = 14


def vectors(n, seed=0):
    """Whole steps, many equal ones, one vector that a tenth of the rows has."""
    r = np.random.default_rng(seed).integers(0, 5, (n, DIMS)) / 4.0
    r[:, :5] = r[:, :5] >= 0.5
    r[: n // 10] = r[0]
    return r


def table(spark, r):
    return spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(r)], "ref_id long, vec array<double>, fraud int")


def rows(df):
    return sorted((r["qid"], r["rk"], r["ref_id"], r["fraud"], r["d"]) for r in df.collect())


def test_cells_equal_the_kernel(spark, monkeypatch):
    for name, value in (("MEMBERS", 40), ("SAMPLE", 500), ("QUERIES", 30)):
        monkeypatch.setattr(cells, name, value)
    refs = table(spark, vectors(1500)).unionByName(spark.createDataFrame([(9000, None, 1)], "ref_id long, vec array<double>, fraud int")).cache()
    queries = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    built = cells.build(refs, DIMS)
    assert len(built.parts) > 8 and built.tree.count[0] == 1500
    for own in (True, False):
        assert rows(cells.nearest(queries, built, 5, own)) == rows(knn_kernel.nearest(queries, refs, 5, DIMS, exclude_self=own))
    monkeypatch.setattr(cells, "FROM_PAIRS", 0)
    assert rows(knn.nearest(queries, refs, 5, DIMS)) == rows(knn_kernel.nearest(queries, refs, 5, DIMS))


def test_local_cells_equal_the_kernel(monkeypatch):
    monkeypatch.setattr(cells, "LOCAL_MEMBERS", 20)
    for n in (1, 4, 900):
        r, ids = vectors(n), np.arange(n)
        fraud = (ids % 2).astype(np.int32)
        q = np.concatenate([r[:50], np.random.default_rng(1).random((20, DIMS))])
        qid = np.arange(len(q))
        best = cells.LocalCells(ids, r, fraud).nearest(qid, q, 5, True)
        at, to, d = knn_kernel.nearest_block(qid, q, ids, r, 5, True)
        assert best.row.tolist() == at.tolist() and best.rid.tolist() == to.tolist() and (best.d == d).all()


def test_references_of_several_blocks_and_beyond_are_streamed(spark, tmp_path):
    """More references than a broadcast holds: an error before."""
    refs = table(spark, vectors(60)).cache()
    body = '{"transaction":{"amount":%d,"installments":2,"requested_at":"2026-04-15T13:42:11Z"},"customer":{"avg_amount":9.5,"tx_count_24h":3},"merchant":{"id":"m","mcc":"5411","avg_amount":5},"terminal":{"is_online":true,"card_present":false,"km_from_home":%d}}'
    lines = [(i, body % (i * 300, i * 40)) for i in range(20)] + [(20, "{"), (21, None)]
    spark.createDataFrame(lines, "qid long, value string").write.parquet(f"{tmp_path}/in")
    incoming = spark.readStream.schema("qid long, value string").parquet(f"{tmp_path}/in")
    got = []
    for size in (1 << 20, 60 * 16 * 8 // 3 + 8, 100):  # one block, three blocks, micro-batches
        out = f"{tmp_path}/{size}"
        for running in append.start(incoming, refs, f"{out}/scored", f"{out}/rejects", f"{out}/checkpoint", once=True, config=ScoringConfig(block_bytes=size)):
            running.awaitTermination()
        columns = ["qid", "parse_ok", "path", "fraud_count", "approved", "response"]
        got.append(sorted(map(tuple, spark.read.parquet(f"{out}/scored").select(columns).collect())))
    assert len(got[0]) == 22 and got[0] == got[1] == got[2]
