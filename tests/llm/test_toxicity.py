import random
import zlib

import numpy as np
import pytest
import pyarrow as pa

from nearvote.llm import toxicity as tox
from tests.llm.conftest import words

INSULTS = ["idiot", "scum", "moron"]


def corpus(n=800, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["w" + str(rng.randrange(3000)) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(INSULTS) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs(rows), marks).collect()}
    assert len(got) == len(rows)
    held = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(r["predicted"] == t for r, t in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_teach_nothing(spark, docs):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r["doc_id"], r["score"]) for r in tox.toxicity(docs(rows), spark.createDataFrame(x, schema)).collect()) for x in (labels, flipped))
    assert a == b


def test_pairs_are_learnt():
    """Two terms that are toxic together only: no linear weights can tell them apart."""
    config = tox.ToxicityConfig()
    rng = random.Random(0)
    cases = [(["aa"], 0), (["bb"], 0), (["aa", "bb"], 1), ([], 1)]
    picked = [rng.choice(cases) for _ in range(400)]
    lists = [x for x in (tox.terms(pa.array([" ".join(w) for w, _ in picked]), config))]
    n, rows, bucket = lists[0]
    parts = [bucket[rows == i] for i in range(n)]
    model = tox.fit(parts, np.array([y for _, y in picked], float), config)
    for w, y in cases:
        (size, r, b), = tox.terms(pa.array([" ".join(w)]), config)
        p = tox.probabilities(model, size, r, b)[0]
        assert (p >= 0.5) == bool(y), (w, p)


@pytest.mark.parametrize("background", [600, 1500, 2200, 5000])
def test_pairs_are_learnt_among_many_other_terms(spark, background):
    """A group's name and an insult, each as frequent in clean rows as in toxic ones, and a
    harmless word beside a toxic one."""
    config = tox.ToxicityConfig()
    rng = random.Random(3)
    cases = [(["group"], 0), (["awful"], 0), (["group", "awful"], 1), ([], 0), (["scum"], 1), (["scum", "movie"], 0), (["movie"], 0)]

    def draw(n):
        out = []
        for _ in range(n):
            w, y = rng.choice(cases)
            text = w + ["w" + str(int(background * rng.random() ** 2)) for _ in range(rng.randrange(5, 60))]
            rng.shuffle(text)
            out.append((" ".join(text), y))
        return out

    def lists(rows):
        return [b[r == i] for n, r, b in tox.terms(pa.array([t for t, _ in rows]), config) for i in range(n)]

    seen, fresh = draw(3000), draw(600)
    model = tox.fit(lists(seen), np.array([y for _, y in seen], float), config)
    right = sum((tox.probabilities(model, 1, np.zeros(len(x), np.int64), x)[0] >= 0.5) == bool(y) for x, (_, y) in zip(lists(fresh), fresh))
    assert right >= 0.97 * len(fresh)
    assert (model.slots >= 0).sum() <= 20
    chance = {t: tox.probabilities(model, 1, np.zeros(len(x), np.int64), x)[0] for t, x in zip(("group awful", "scum"), lists([("group awful", 1), ("scum", 1)]))}
    assert min(chance.values()) >= 0.9
    if background == 1500:  # the same screen by Spark's tasks
        labels, xs = np.array([y for _, y in seen], float), lists(seen)
        assert (tox.fit(xs, labels, config, spark).slots >= 0).sum() == (model.slots >= 0).sum()


def test_pairs_count_only_what_their_terms_do_not_explain():
    """A term that is toxic a little more often than weights explain makes no pair by itself."""
    config = tox.ToxicityConfig(min_z=1e9)  # no weights of single terms
    rng = random.Random(4)
    rows, labels = [], []
    for _ in range(4000):
        group = rng.random() < 0.3
        rows.append(np.unique([*([1] if group else []), *(rng.randrange(2, 200) for _ in range(20))]).astype(np.int32))
        labels.append(float(rng.random() < (0.7 if group else 0.2)))
    labels = np.array(labels)
    with_term = np.bincount(np.concatenate(rows), minlength=config.buckets)
    base = np.full(len(labels), labels.mean())
    assert len(tox.paired(rows, labels, base, with_term, config)) == 0
    both = np.array([1 in r and 7 in r for r in rows])
    assert set(tox.paired(rows, np.where(both, 1.0 - labels, labels), base, with_term, config).tolist()) <= {1, 7}


def test_score_equals_the_plain_formula():
    config = tox.ToxicityConfig(buckets=64, factors=3)
    rng = np.random.default_rng(1)
    model = tox.Model(0.3, np.arange(64, dtype=np.int32), rng.normal(0, 0.2, 64), rng.normal(0, 0.2, (64, 3)))
    (n, rows, bucket), = tox.terms(pa.array(["one two three, four", "", None, "one one"]), config)
    got = tox.probabilities(model, n, rows, bucket)
    for i in range(n):
        x = bucket[rows == i]
        z = 0.3 + sum(model.weights[a] for a in x) + sum(model.factors[a] @ model.factors[b] for k, a in enumerate(x) for b in x[k + 1 :])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12


def test_terms_are_distinct_words_and_stems():
    config = tox.ToxicityConfig()
    text = "Idiot, idiot! IDIOT idiotic (idiots) a ... " + "long " * 50
    (n, rows, bucket), = tox.terms(pa.array([text]), config)
    assert len(words(text)) > 50
    # idiot, idiotic, idiots, a, long; the stem of the two longer words
    assert n == 1 and len(bucket) == len(set(bucket.tolist())) == 6


def test_odd_inputs(spark, docs, odd_texts):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    got = tox.toxicity(docs(odd_texts), none).collect()
    assert len(got) == len(odd_texts) and all(r["predicted"] == 0 for r in got)
    odd = spark.createDataFrame([(None, 0, 1), (1, None, None), (3, 0, 0), (3, 0, 1), (77777, 1, 1), (8, 0, 0)], schema)
    assert tox.toxicity(docs(odd_texts + [(None, "idiot")]), odd).count() == len(odd_texts) + 1
    assert tox.toxicity(docs([]), odd).count() == 0


def test_sample_is_bounded(spark, docs):
    rows, labels = corpus(200)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    config = tox.ToxicityConfig(max_rows=50)
    assert tox.sample(docs(rows), marks, config, "doc_id", "text", "toxic", 5).count() == 50
    assert tox.sample(docs(rows * 3), marks, config, "doc_id", "text", "toxic", 5).count() == 50
    # One id with more rows than the sample may have takes what is left, and no more.
    first = tox.sample(docs(rows), marks, tox.ToxicityConfig(max_rows=1), "doc_id", "text", "toxic", 5).first()
    hot = docs(rows + [(first["id"], f"copy {i}") for i in range(80)])
    assert tox.sample(hot, marks, config, "doc_id", "text", "toxic", 5).count() == 50
    model = tox.train(tox.sample(hot, marks, tox.ToxicityConfig(max_rows=90), "doc_id", "text", "toxic", 5), config)
    assert np.isfinite(model.bias)
