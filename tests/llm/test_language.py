import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearvote.llm import language, text
from nearvote.llm.language import LanguageConfig, identify_languages, label_languages, train, viterbi

PARTS = {"en": ["the", "ing", "th", "and", "er", "wh"], "fr": ["eau", "eux", "ment", "ou", "é", "que"], "ru": ["при", "вет", "ста", "ние", "ого"], "el": ["και", "τος", "ων", "μα"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, lang, rng.randrange(3, 60)), lang) for i in range(n) for lang in [rng.choice(list(PARTS))]]


def test_held_out_accuracy(docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in identify_languages(docs(rows)).collect()}
    held = [(got[i], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and len(held) == sum(r["held_out"] for r in got.values())
    assert sum(r["lang_pred"] == lang for r, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_languages_teach_nothing(docs):
    rows = corpus(200)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(docs(x)).collect()) for x in (rows, other))
    assert a == b and "xx" not in {x for _, x, _ in a}


def test_spans_of_a_mixed_text(docs):
    rng = random.Random(5)
    model = train(docs(corpus()).select("text", "lang"))
    mixed = prose(rng, "en", 40) + " " + prose(rng, "fr", 30) + " " + prose(rng, "ru", 20)
    (r,) = label_languages(docs([(1, mixed)]), model).collect()
    assert [s["lang"] for s in r["spans"]] == ["en", "fr", "ru"]
    assert [s["first_word"] for s in r["spans"]] == [0, r["spans"][0]["end_word"], 70]
    assert abs(r["spans"][1]["first_word"] - 40) <= 2 and r["spans"][-1]["end_word"] == 90
    assert r["lang_pred"] == "en"


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(0, 7, 5)
        first = np.concatenate(([0], np.cumsum(lengths)))
        scores = rng.normal(0, 2, (first[-1], 3)).astype(np.float32)
        labels = viterbi(scores.copy(), first, 1.5)

        def value(path, a):
            return sum(float(scores[a + i, x]) for i, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

        for a, b in zip(first[:-1], first[1:]):
            best = max((value(p, a) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert abs(value(labels[a:b].tolist(), a) - best) < 1e-4


def test_blocks_of_a_long_text_give_the_same(docs, monkeypatch):
    rng = random.Random(6)
    model = train(docs(corpus()).select("text", "lang"))
    long = " ".join(prose(rng, rng.choice(list(PARTS)), rng.randrange(1, 60)) for _ in range(200)) + " 12 !? x"
    texts = [long, "a", "", "12 34", "é"]
    column = pa.array(texts)
    for (row, _, words), t in zip(text.iterate(column, 1), texts):
        scores, lettered = language.emissions(model, words, LanguageConfig())
        want = viterbi(scores, words.first, LanguageConfig().switch)
        for size in (1, 7, 1000, 1 << 20):
            labels, letters = language.label_long(model, words, LanguageConfig(), size)
            assert (labels == want).all() and (letters == lettered).all(), (size, t[:20])
    # Through the operator: a bound that only the long text is beyond.
    rows = docs([(i, t) for i, t in enumerate(texts)] + [(9, None)])
    want = sorted(map(str, label_languages(rows, model).collect()))
    monkeypatch.setattr(language, "TOGETHER", 1000)
    monkeypatch.setattr(language, "LONG", 4 * 100)
    assert sorted(map(str, label_languages(rows, model).collect())) == want


def test_values_stay_exact_in_a_long_text():
    # A switch pays off by a hair after a million words of poor scores.
    n = 1_000_000
    scores = np.full((n, 2), -9.75, np.float32)
    scores[:, 1] -= 0.01
    scores[-1] = (-1.6, 0)
    (a, b), switch = viterbi(scores, np.array([0, n]), 1.5)[-2:], 1.5
    assert switch < 1.6 and (a, b) == (0, 1)


def test_scripts_narrow_the_candidates(docs):
    model = train(docs(corpus()).select("text", "lang"))
    cyrillic = 1 + [n for n, _, _ in language.SCRIPTS].index("cyrillic")
    assert [x for x, ok in zip(model.languages, model.allowed[cyrillic]) if ok] == ["ru"]
    han = 1 + [n for n, _, _ in language.SCRIPTS].index("han")
    assert model.allowed[han].all()
    # Words never seen, in a script of one language
    (r,) = label_languages(docs([(1, "жщъ ыфх")]), model).collect()
    assert r["lang_pred"] == "ru"


def test_small_languages_stay_candidates_beside_a_large_one(docs):
    rng = random.Random(8)
    small = [(1000 + i, prose(rng, "fr", 10), "fr") for i in range(3)]
    rows = [(i, prose(rng, "en", 300), "en") for i in range(150)] + small
    model = train(docs(rows).select("text", "lang"))
    latin = 1 + [n for n, _, _ in language.SCRIPTS].index("latin")
    assert model.allowed[latin].all()
    got = {r["id"]: r["lang_pred"] for r in label_languages(docs(small), model).collect()}
    assert got == {i: "fr" for i, _, _ in small}
    # What is learnt of a language doesn't depend on how much text others have.
    alone = train(docs([*small, rows[0]]).select("text", "lang"))
    assert (alone.allowed == model.allowed).all()


def test_odd_texts(docs, odd_texts):
    rows = [(i, t, "en" if i % 2 else None) for i, t in odd_texts] + [(50, "12 34 !?"), (51, "+++"), (None, "text"), (3, "One")]
    got = {}
    for r in identify_languages(docs(rows)).collect():
        got[r["doc_id"]] = r
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2, 50, 51}
    assert got[9]["lang_pred"] == "en"
    assert identify_languages(docs([])).count() == 0
    blank = identify_languages(docs([(1, "text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in blank] == [("und", 0.0)]
    assert LanguageConfig().switch > 0


def test_many_languages(docs):
    rng = random.Random(12)
    parts = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for i in range(150)}
    rows = [(n, " ".join(rng.choice(p) + rng.choice(p) for _ in range(30)), lang) for n, (lang, p) in enumerate((x for x in parts.items() for _ in range(5)))]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(docs(rows)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    with pytest.raises(ValueError):
        train(docs(rows).select("text", "lang"), LanguageConfig(max_languages=149))
