"""Exact top-k and hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.llm.exact_topk import TopKConfig, exact_top_k
from nearvote.llm.hard_negatives import NegativesConfig, fit_centroids, hard_negatives
from nearvote.operators.routed import RoutedConfig, RoutedStats

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("id", "vec", "q", "score", "query", "anchor", "slot", "mark"))])
EXTRA = ("x",) * 8


def make(spark, rows, parts=4):
    typed = [(i, None if v is None else [None if x is None else float(x) for x in v], m, *EXTRA) for i, v, m in rows]
    return spark.createDataFrame(typed, SCHEMA).repartition(parts)


def whole(vec):
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vec]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every):
    kept = [(i, whole(v)) for i, v, *_ in rows if i is not None and whole(v) is not None]
    out = []
    for q, v in kept:
        if q % every == 0:
            best = sorted((-dot(v, w), i) for i, w in kept if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every, c=NegativesConfig()):
    by_id = {}
    for i, v, label in rows:
        if i is not None and label is not None and whole(v) is not None:
            by_id.setdefault(i, []).append((label, whole(v)))
    kept = {i: min(x) for i, x in by_id.items()}
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, m) for i, (m, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][: c.positives]:
            fit = [(n, i) for n, i, m in scored if m != label and c.low * -s <= 100 * -n <= c.high * -s][: c.negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def vectors(n, dims, seed, copies=0):
    """Clustered vectors with labels, ``copies`` of one of them, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[1][1], rng.randrange(4)) for i in range(copies)]
    odd = [(5000, None, 1), (5001, [None] * dims, 1), (5002, [float("nan")] * dims, 1), (5003, [float("inf")] * dims, 2), (None, rows[0][1], 1), (5010, rows[3][1], None)]
    return rows + odd


def collected(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("config", [TopKConfig(), TopKConfig(k=3, rows=7), TopKConfig(block_bytes=500)])
def test_top_k_equals_brute_force(spark, config):
    rows = vectors(300, 8, 2, copies=120)
    got = collected(exact_top_k(make(spark, rows), F.col("vec_id") % 10 == 0, config))
    assert got == brute_top(rows, config.k, 10)


def test_top_k_of_odd_vectors(spark):
    """Unequal lengths, empty and sparse vectors, huge components, too few candidates."""
    rows = [(0, [1.0, 2.0, 3.0], 1), (1, [1.0], 1), (2, [], 1), (3, [0.0, 0.0, 5.0], 1), (10, [-1.0, 1e9], 1), (4, [-1e9, 0.0], 1)]
    assert collected(exact_top_k(make(spark, rows), F.col("vec_id") % 10 == 0)) == brute_top(rows, 5, 10)
    assert collected(exact_top_k(make(spark, rows[:1]), F.col("vec_id") % 10 == 0)) == []
    assert collected(exact_top_k(make(spark, []), F.col("vec_id") % 10 == 0)) == []
    wide = [(0, [3e12, 0.0], 1), (5, [0.0, 3e12], 1), (1, [1.0, 0.0], 1), (2, [2.0**-30, -2.0**-30], 1)]  # bounds beyond 64 bits, scores within
    assert collected(exact_top_k(make(spark, wide), F.col("vec_id") % 5 == 0)) == brute_top(wide, 5, 5)
    big = [(0, [1e6] * 4, 1), (2, [3e37, 0.0, 0.0, 0.0], 1)]
    with pytest.raises(Exception, match="(?i)overflow|too big|too large|int"):
        exact_top_k(make(spark, big), F.col("vec_id") == 0).collect()


def test_repeated_queries_are_answered_each(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.25, 1.0], 1)]
    assert collected(exact_top_k(make(spark, rows), F.col("vec_id") == 0)) == [(0, 1, 1, 256 * 64 + 128 * 256)] * 2


@pytest.mark.parametrize("routed", [RoutedConfig(), RoutedConfig(first=1, growth=2, block_rows=16, cell_blocks=2, cell_queries=8)])
def test_negatives_equal_brute_force(spark, routed):
    rows = vectors(400, 8, 3, copies=150)
    stats = RoutedStats(), RoutedStats()
    got = collected(hard_negatives(make(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), NegativesConfig(routed=routed), stats=stats))
    assert got == brute_negatives(rows, 10)
    assert len(got) > 100
    for s in stats:
        assert s.coarse > 0 and sum(s.pairs) > 0 and s.measured > 0


def test_negatives_of_odd_vectors(spark):
    """Negative scores, repeated ids, unequal lengths, large components, no positives, one label."""
    anchor = F.col("vec_id") % 5 == 0
    rows = [(0, [1.0, 1.0], 1), (1, [-1.0, -1.0], 1), (2, [1.0], 1), (3, [0.7, 0.1], 2), (3, [0.7, 0.1], 2), (3, [0.9], 3), (4, [0.4, 0.4], 2), (5, [2.0, -1.0], 7), (6, [], 2), (7, [0.0, 0.0], 1)]
    assert collected(hard_negatives(make(spark, rows), anchor, F.col("label"))) == brute_negatives([r if len(r[1]) == 2 else (r[0], [*r[1], *[0.0] * (2 - len(r[1]))], r[2]) for r in rows], 5)
    assert collected(hard_negatives(make(spark, []), anchor, F.col("label"))) == []
    assert collected(hard_negatives(make(spark, [(0, [], 1), (1, [], 2)]), anchor, F.col("label"))) == []
    assert collected(hard_negatives(make(spark, [(i, [1.0, i / 4], 1) for i in range(9)]), anchor, F.col("label"))) == []
    big = [(i, [1e5 * math.sin(i), 3e5 * math.cos(i)], i % 3) for i in range(40)]
    assert collected(hard_negatives(make(spark, big), anchor, F.col("label"))) == brute_negatives(big, 5)


def test_centroids_of_copies_and_single_rows():
    assert len(fit_centroids(np.zeros((50, 3)), 8, 3)) == 1
    assert fit_centroids(np.array([[4.0, 5.0]]), 3, 2).tolist() == [[4.0, 5.0]]
