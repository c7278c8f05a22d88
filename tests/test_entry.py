import __spark_entry__ as entry


def test_every_query_is_registered_with_its_twin():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    without = {q for q in queries if q not in sql and not q.startswith("op") and q != "pipeline"}
    assert without == {"accuracy_report", "kmeans_fit"}


def test_flagship(spark):
    import os

    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).columns == ["qid", "fraud_count", "approved", "fraud_score"]
