import pytest

from nearvote.plans import queries, views

SF = "/root/testdata/sf0.001"


class Reached(Exception):
    """Ends a query once its references are known."""


def caught(monkeypatch, module, name, place):
    """The ids of the references that reach a function, and its other arguments."""
    seen = {}

    def stop(*args, **kwargs):
        seen["refs"] = sorted(r["ref_id"] for r in args[place].select("ref_id").collect())
        seen["args"] = args
        raise Reached

    monkeypatch.setattr(module, name, stop)
    return seen


def events(spark):
    return sorted(r["event_id"] for r in views.event_requests(spark, SF).select("event_id").collect())


def test_accuracy_report_knows_all_events(spark, monkeypatch):
    seen = caught(monkeypatch, queries.knn_kernel, "nearest", 1)
    with pytest.raises(Reached):
        queries.accuracy_report(spark, SF)
    assert seen["refs"] == events(spark) and seen["args"][0].count() == 10_000


def test_path_counters_knows_all_events_but_the_queries(spark, monkeypatch):
    seen = caught(monkeypatch, queries.kmeans, "seeds", 0)
    with pytest.raises(Reached):
        queries.path_counters(spark, SF)
    assert seen["refs"] == [i for i in events(spark) if i % 50]


def test_stream_score_knows_all_events(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.scoring, "run_once", lambda spark, incoming, detector, *paths: seen.update(detector=detector) or incoming.withColumn("batch", incoming.qid))
    queries.stream_score(spark, SF)
    got = caught(monkeypatch, queries.knn, "nearest", 1)
    with pytest.raises(Reached):
        seen["detector"](None)
    assert got["refs"] == events(spark)
