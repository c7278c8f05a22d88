import gzip
import json
import random

from pyspark.sql import functions as F

from nearvote.__main__ import _constants, accuracy, main, sweep, timing
from nearvote.streaming.scoring import score_requests


def test_commands(spark, tmp_path):
    rng = random.Random(1)
    refs = [{"vector": [round(rng.random(), 4) for _ in range(14)], "label": rng.choice(["fraud", "legit"])} for _ in range(120)]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(refs, f)
    at = f"file://{tmp_path}"
    for kind in ("ivf", "exact"):
        assert main(["preprocess", f"{at}/refs.json.gz", f"{at}/{kind}", "--k", "4", "--iterations", "1", "--format", kind, "--nprobe", "2"], spark) == 0
    assert main(["accuracy", f"{at}/ivf", f"{at}/exact", "--count", "50"], spark) == 0
    assert accuracy(spark, f"{at}/ivf", f"{at}/exact", 50, 1).first()["n"] == 50
    assert main(["payloads", f"{at}/payloads", "--count", "30"], spark) == 0
    assert timing(spark, f"{at}/ivf", f"{at}/payloads", 100)["rows"] == 30
    entries = [{"request": {"transaction": {"amount": i}}, "expected_approved": bool(i % 2), "expected_fraud_score": 0.0} for i in range(10)]
    (tmp_path / "tests.json").write_text(json.dumps({"entries": entries}))
    rows = sweep(spark, f"{at}/ivf", f"{at}/tests.json").collect()
    assert [r["min_count"] for r in rows][:3] == [1, 2, 3] and all(r["n"] == 10 for r in rows)
    # Loaded constants reach the features: other risks, other rounding of amounts.
    (tmp_path / "mcc.json").write_text(json.dumps({"5411": 0.9}))
    names = ("max_amount", "max_installments", "amount_vs_avg_ratio", "max_minutes", "max_km", "max_tx_count_24h", "max_merchant_avg_amount")
    (tmp_path / "norm.json").write_text(json.dumps({n: 5.0 for n in names}))
    given = ["--mcc-risk", f"{at}/mcc.json", "--normalization", f"{at}/norm.json"]
    assert main(["sweep", f"{at}/ivf", f"{at}/tests.json", *given], spark) == 0
    norm, risks = _constants(spark, f"{at}/mcc.json", f"{at}/norm.json")
    assert norm.max_amount == 5.0 and risks == {"5411": 0.9} and _constants(spark, None, None)[1] is None
    raw = spark.createDataFrame([(1, json.dumps({"transaction": {"amount": 2.5}, "merchant": {"mcc": "5411"}}))], "qid long, value string")
    seen = []

    def detector(rows):
        seen.extend(list(r["qv"]) for r in rows.collect())
        return rows.select("qid", F.lit(0).alias("fraud_count"), F.lit("x").alias("path"))

    assert score_requests(raw, detector, norm, risks=risks).first()["path"] == "x"
    assert seen[0][0] == 0.5 and any(abs(x - 0.9) < 1e-6 for x in seen[0])
