import random

import pytest

import corpus_pipeline
from nearvote.llm import common
from nearvote.llm.toxicity import ToxicityConfig, sample, score, train
from tests.llm.conftest import words
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_join import brute as copies
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Documents with insults, near copies, leaks, secrets and odd rows; labels; a benchmark."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(14, 50)))) for i in range(8)]
    rows, labels = [], []
    for i in range(360):
        w = [rng.choice(pool) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 1
        if toxic:
            w[3] = rng.choice(["idiot", "scum"])
        if i % 10 == 2:
            w[5:5] = words(rng.choice(items)[1])
        if i % 10 == 4:
            w.append(f"password={rng.getrandbits(64):016x}")
        if i % 10 == 6 and rows:
            w = rows[-2][1].split(" ")
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, "one"), (903, rows[0][1]), (904, rows[0][1])]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_every_stage_by_brute_force(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    state = rows
    for name, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, path), f"file://{tmp_path}/{name}")
        got = docs.collect()
        if name == "packing":
            assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in state)
            assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(words(t)) for i, t in state}
            continue
        assert docs.columns == columns
        after = sorted(((r["doc_id"], r["text"]) for r in got), key=lambda x: x[0])
        if name == "toxicity":
            bad = {i for i, t in state if {"idiot", "scum"} & set(words(t))}
            assert {i for i, _ in state} - {i for i, _ in after} == bad and bad
        elif name == "ngram_jaccard_join":
            assert {i for i, _ in after} == {i for i, _, c in copies(state, 5, 80) if i == c} and len(after) < len(state)
        elif name == "decontamination":
            bad = {d for d, _ in leaks(state, items)}
            assert {i for i, _ in after} == {i for i, _ in state} - bad and bad
        else:
            assert len(after) == len(state) and not any(base(t) for _, t in after)
            before = dict(state)
            for r in got:
                assert r["text"] == before[r["doc_id"]] or base(before[r["doc_id"]])
                assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
            assert any("[secret]" in (t or "") for _, t in after)
        state = after


def test_odd_ids_and_clashing_columns(spark, folder, tmp_path):
    """Equal rows, null and repeated ids, and columns called as the stages' helpers might be."""
    path, labelled, items = folder
    names = ("toxicity", "_toxicity", "number", "_kept", "_leak", "component_id", "digest", "base", "spans", "item_id", "kept", "body")
    rng = random.Random(4)
    own = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    leak = own[1][:80] + " " + items[2][1] + " " + own[1][80:]
    rows = [(7, own[0]), (7, own[0]), (None, own[0]), (None, own[0]), (8, own[1]), (8, leak), (None, leak), (9, own[2] + " idiot"), (None, "scum " + own[2]), (None, None), (None, None), (3, ""), (3, ""), (None, own[3] + " password=abcdefgh12345678")]
    rows += [(i, t) for i, t in labelled if i % 2 and 10 < i < 900]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, *[f"{n}!" for n in names]) for i, t in rows], schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, path), f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        got = docs.collect()
        assert all(r[n] == f"{n}!" for r in got for n in names)
        if name == "toxicity":
            assert not any(own[2] in (r["text"] or "") for r in got) and sum(r["doc_id"] is None for r in got) == 6
        if name == "ngram_jaccard_join":
            assert sum(r["text"] == own[0] for r in got) == 1 and [r["doc_id"] for r in got if r["text"] == own[0]] == [7]
            assert sum(not r["text"] for r in got) == 4
        if name == "decontamination":
            assert [r["text"] for r in got if r["doc_id"] == 8] == [own[1]] and not any(r["text"] == leak for r in got)
    assert any(r["text"] == own[3] + " [secret]" for r in got)
    assert corpus_pipeline.pack_batches(spark, docs, path).count() == len(got)


def test_run_chains_the_stages(spark, folder):
    path, rows, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert 0 < got.count() < len(rows)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_model_of_the_first_stage_is_the_operator(spark, folder):
    path, rows, _ = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    config = ToxicityConfig()
    model = train(sample(docs, labels, config, "doc_id", "text", "toxic", None), config)
    kept = {r["doc_id"] for r in score(docs, model, config, out="p").where("p < 0.5").collect()}
    assert kept == {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, path).collect()}
    assert {900, 901, 902} <= kept


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    empty = f"file://{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
