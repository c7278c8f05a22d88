import random

import numpy as np
import pytest

from nearvote.llm import common, ngram_join, text
from nearvote.llm.ngram_join import JoinConfig, divide_skip, ngram_jaccard_join, parity
from tests.llm.conftest import words


def shingles(value, k):
    w = words(value)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        find(i)
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return sorted((i, len(x), find(i)) for i, x in sets)


def corpus(rng, n=120):
    """Prose with groups of near copies, a shared passage and a hot line."""
    pool = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(pool) for _ in range(rng.randrange(30, 200))] for _ in range(12)]
    passage = [rng.choice(pool) for _ in range(60)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
        else:
            w = [rng.choice(pool) for _ in range(rng.randrange(1, 150))]
            if i % 3 == 1:
                w = w[:20] + passage + w[20:40]
        out.append((i, "The hot line of all\n" * (i % 2) + " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_equals_brute_force(docs, k, percent, seed):
    rows = corpus(random.Random(seed))
    got = sorted(map(tuple, ngram_jaccard_join(docs(rows), k, percent).collect()))
    assert got == brute(rows, k, percent)


def test_odd_texts(docs, odd_texts):
    got = sorted(map(tuple, ngram_jaccard_join(docs(odd_texts)).collect()))
    assert got == brute(odd_texts, 4, 85)
    assert {i for i, n, _ in got if n == 0} == {0, 1, 2}


@pytest.mark.parametrize("cell", [1 << 19, 1 << 8])
def test_large_group_of_near_copies_is_one_component(docs, cell, monkeypatch):
    """Also where its lists are spread over many cells."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"e{i}-{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = ngram_jaccard_join(docs(rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85)


def test_pairs_of_a_group_edited_unevenly_grow_with_its_members(docs, monkeypatch):
    """Most of its members link with those only that were edited least."""
    rng = random.Random(6)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"e{i}-{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows = list({t: (i, t) for i, t in rows}.values())
    counts, inner = [], ngram_join.linking
    monkeypatch.setattr(ngram_join, "linking", lambda docs, pairs, *more: counts.append(pairs.distinct().count()) or inner(docs, pairs, *more))
    got = ngram_jaccard_join(docs(rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85)
    assert sum(counts) <= 20 * len(rows), counts


def test_empty_table_nulls_and_repeats(docs):
    assert ngram_jaccard_join(docs([])).count() == 0
    rows = [(7, "a b c d e f"), (7, "g h i j k l"), (3, "g h i j k l"), (None, "a b c d e f"), (None, "only here in this row"), (9, None)]
    got = sorted(map(tuple, ngram_jaccard_join(docs(rows)).collect()), key=str)
    assert got == sorted([(7, 3, 3), (7, 3, 3), (3, 3, 3), (None, 3, 3), (None, 2, None), (9, 0, 9)], key=str)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        base = np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64))
        sets = []
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) < rng.choice([0.3, 0.9, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(400, 800, rng.integers(0, 12)).astype(np.uint64)])))
        for percent in (50, 80, 85, 100):
            want = [j for j, s in enumerate(sets) if len(s) and 100 * len(np.intersect1d(base, s)) >= percent * len(np.union1d(base, s))]
            assert divide_skip(base, sets, percent) == want
    assert divide_skip(np.zeros(0, np.uint64), sets, 80) == []


def test_parity_bounds_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        b = np.union1d(b, a[: len(a) // 2])
        apart = sum(int(x).bit_count() for x in np.bitwise_xor(parity(a), parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_required_overlap():
    config = JoinConfig()
    for n in range(1, 200):
        t = config.required(n)
        assert 100 * t >= 85 * n > 100 * (t - 1)


def test_components(spark, tmp_path):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "u long, v long"), f"file://{tmp_path}").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_words_match_the_pattern(odd_texts):
    import pyarrow as pa

    values = [t for _, t in odd_texts]
    seen = {}
    for a, b, w in text.iterate(pa.array(values)):
        for i in range(a, b):
            want = words(values[i])
            own = slice(w.first[i - a], w.first[i - a + 1])
            got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts[own], w.ends[own])]
            assert got == want
            for x, h in zip(want, w.hashes[own].tolist()):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
