import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from nearvote.config import Normalization
from nearvote.functions import scores
from nearvote.operators import generate
from nearvote.operators.features import featurize, parse_requests, risk

# A request and its vector.
GOLDEN_REQUEST = '{"id":"tx-1","transaction":{"amount":250.00,"installments":1,"requested_at":"2026-04-15T13:42:11Z"},"customer":{"avg_amount":180.00,"tx_count_24h":3,"known_merchants":["m-001","m-002"]},"merchant":{"id":"m-001","mcc":"5411","avg_amount":200.00},"terminal":{"is_online":true,"card_present":true,"km_from_home":2.5},"last_transaction":{"timestamp":"2026-04-15T11:10:00Z","km_from_current":1.8}}'
GOLDEN = [0.025, 0.0833, 0.1389, 0.5652, 0.3333, 0.1057, 0.0018, 0.0025, 0.15, 1, 1, 0, 0.15, 0.02]


#: Edge cases of request documents: (case, document).
CASES = (
    ("numeric_mcc", '{"transaction":{"amount":31.75,"installments":2,"requested_at":"2025-02-05T08:09:10Z"},"customer":{"avg_amount":44.10,"tx_count_24h":6,"known_merchants":["shop-a"]},"merchant":{"id":"shop-b","mcc":5411,"avg_amount":71.20},"terminal":{"is_online":true,"card_present":false,"km_from_home":9.25},"last_transaction":null}'),
    ("spaced_mcc", '{"transaction":{"amount":70707,"installments":36,"requested_at":"2025-02-08T23:00:00+03:00"},"customer":{"avg_amount":0,"tx_count_24h":77,"known_merchants":[]},"merchant":{"id":"shop-b","mcc":" +7995 ","avg_amount":1},"terminal":{"is_online":false,"card_present":false,"km_from_home":12345}}'),
    ("text_amount", '{"transaction":{"amount":"31","installments":2,"requested_at":"2025-02-05T08:09:10Z"},"customer":{"avg_amount":44.10,"tx_count_24h":6},"merchant":{"id":"shop-a","mcc":"123456","avg_amount":"x"},"terminal":{"is_online":"yes"}}'),
    ("fractional_count", '{"transaction":{"amount":8,"installments":2.5,"requested_at":"2025-02-05T08:09:10Z"},"customer":{"avg_amount":4,"tx_count_24h":6},"merchant":{"id":"s"},"terminal":{}}'),
    ("backwards", '{"transaction":{"amount":8,"installments":2,"requested_at":"2025-02-05T08:09:10Z"},"customer":{"avg_amount":4,"tx_count_24h":6},"merchant":{"id":"s"},"terminal":{},"last_transaction":{"timestamp":"2025-02-07T08:09:10Z","km_from_current":7}}'),
    ("short_stamp", '{"transaction":{"amount":8,"installments":2,"requested_at":"2025-02-08"},"customer":{"avg_amount":4,"tx_count_24h":6},"merchant":{"id":"s"},"terminal":{}}'),
    ("one_stamp", '{"transaction":{"amount":8,"installments":2,"requested_at":"2025-02-08"},"customer":{"avg_amount":4,"tx_count_24h":6},"merchant":{"id":"s"},"terminal":{},"last_transaction":{"timestamp":"2025-02-07T08:09:10Z","km_from_current":7}}'),
    ("broken", '{"transaction":'),
    ("empty_object", "{}"),
)


def vectors(spark, payloads):
    raw = spark.createDataFrame(list(payloads), "case string, value string")
    return {r["case"]: r for r in featurize(parse_requests(raw)).collect()}


def test_golden_vector(spark):
    got = vectors(spark, [("golden", GOLDEN_REQUEST)])["golden"]["vec"]
    assert got == pytest.approx(GOLDEN, abs=1e-6)


def test_edge_cases(spark):
    got = vectors(spark, CASES)
    assert {k for k, r in got.items() if not r["parse_ok"]} == {"fractional_count", "one_stamp", "broken"}
    assert all(got[k]["vec"] is None for k in ("fractional_count", "one_stamp", "broken"))
    v = {k: r["vec"] for k, r in got.items() if r["vec"]}
    assert v["numeric_mcc"][12] == pytest.approx(0.5)
    assert v["numeric_mcc"][5:7] == [-1.0, -1.0] and v["numeric_mcc"][11] == 1
    assert v["spaced_mcc"][12] == pytest.approx(0.85) and v["spaced_mcc"][2] == 1.0
    assert v["spaced_mcc"][:2] == [1.0, 1.0]
    assert v["spaced_mcc"][3] == pytest.approx(1.0) and v["spaced_mcc"][4] == pytest.approx(0.8333)
    assert v["text_amount"][0] == 0 and v["text_amount"][12] == pytest.approx(0.5)
    assert v["backwards"][5] == 0
    assert v["short_stamp"][3] == 0 and v["short_stamp"][4] == pytest.approx(0.3333)


def test_body_size_and_nulls(spark):
    raw = spark.createDataFrame([("a", "{}" + " " * 5000), ("b", None)], "case string, value string")
    assert [r["parse_ok"] for r in parse_requests(raw, max_body=4096).orderBy("case").collect()] == [False, False]


def test_only_first_32_known_merchants_count(spark):
    names = [f"m-{i}" for i in range(40)]
    doc = lambda m: json.dumps({"customer": {"known_merchants": names}, "merchant": {"id": m}})
    got = vectors(spark, [("in", doc("m-31")), ("out", doc("m-32"))])
    assert got["in"]["vec"][11] == 0 and got["out"]["vec"][11] == 1


def test_rounding_is_half_even(spark):
    rows = spark.createDataFrame([(0.00125,), (0.00135,), (0.5,)], "x double")
    assert [r[0] for r in rows.select(scores.round4(F.col("x"))).collect()] == [0.0012, 0.0014, 0.5]


def test_weekday_and_minutes_match_the_calendar(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(4 * 365 * 86400))
        last = at - dt.timedelta(seconds=rng.randrange(0, 90_000))
        rows.append((str(i), json.dumps({"transaction": {"requested_at": at.isoformat() + "Z"}, "last_transaction": {"timestamp": last.isoformat() + "Z", "km_from_current": 1}}), at, last))
    got = vectors(spark, [r[:2] for r in rows])
    for key, _, at, last in rows:
        v = got[key]["vec"]
        assert v[3] == pytest.approx(round(at.hour / 23, 4), abs=1e-6)
        assert v[4] == pytest.approx(round(at.weekday() / 6, 4), abs=1e-6)
        assert v[5] == pytest.approx(round(min(1, (at - last).total_seconds() / 60 / 1440), 4), abs=1.01e-4)


def test_risk_tolerates_signs_and_ranges(spark):
    rows = spark.createDataFrame([("+5411",), (" 7995 ",), ("99999",), ("x",), (None,)], "m string")
    assert [r[0] for r in rows.select(risk(F.col("m"))).collect()] == [0.15, 0.85, 0.5, 0.5, 0.5]


def test_normalization_needs_every_constant():
    whole = json.dumps(Normalization().__dict__)
    assert Normalization.parse(whole) == Normalization()
    with pytest.raises(KeyError):
        Normalization.parse("{}")


def test_payload_grid(spark):
    rows = generate.payload_grid(spark, 500).orderBy("i").collect()
    assert len(rows) == 500
    first, last = json.loads(rows[0]["value"]), json.loads(rows[-1]["value"])
    assert first["transaction"]["amount"] == 10.0 and first["merchant"]["mcc"] == "5411"
    assert last["transaction"]["amount"] == 50000.0 and last["merchant"]["mcc"] == "4121"
    assert (first["id"], last["id"]) == ("warm-tx-1", "warm-tx-500")
    assert (first["terminal"]["km_from_home"], first["last_transaction"]["km_from_current"]) == (0.2, 0.1)
    assert first["customer"]["known_merchants"] == [] and len(last["customer"]["known_merchants"]) == 5
    assert generate.payload_grid(spark).count() == 200


def test_query_vectors(spark):
    rows = generate.query_vectors(spark, 2000, seed=3).collect()
    assert len({tuple(r["qv"]) for r in rows}) == 2000
    none = [r for r in rows if r["qv"][5] == -1]
    assert 50 < len(none) < 160 and all(r["qv"][6] == -1 for r in none)


def test_responses(spark):
    rows = spark.range(6).select(scores.response(F.col("id").cast("int")).alias("r"), scores.fraud_score(F.col("id") + 6).alias("s")).collect()
    assert json.loads(rows[2]["r"]) == {"approved": True, "fraud_score": 0.4}
    assert json.loads(rows[3]["r"]) == {"approved": False, "fraud_score": 0.6}
    assert rows[0]["s"] == 0.0
