import math
import random
import re

import numpy as np
import pytest

from nearvote.llm.ranked_search import RankConfig, Slices, rank_documents, top
from tests.llm.conftest import LOWER

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Ranks by the formula, document by document."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, want in asked.items():
        scored = []
        for place, (i, t) in enumerate(held):
            m = 10 + (90 * len(t) * n_docs) // total
            score = 0
            for x in want & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, place))
        out += [(item, r + 1, held[p][0], -s) for r, (s, _, _, p) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_ranks_equal_the_formula(spark, docs, odd_texts):
    rng = random.Random(1)
    words = [f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(20_000)]
    texts = list(odd_texts) + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(600)]
    texts += [(800 + i, texts[-1][1]) for i in range(300)]  # ties beyond k
    texts += [(None, "w1 w2 w3"), (None, "w1 w2"), (7, "w5 w5, w5. W6!")]
    items = [(0, texts[-1][1]), (1, "W1 w2-w3 (w4)"), (2, None), (3, "..."), (4, "same SAME ünï 世界 é"), (5, "nowhere"), (1, "w9 w250"), (None, "w7")]
    for config in (RankConfig(block_docs=1 << 14), RankConfig(k=3, block_docs=64), RankConfig(block_docs=130, block_pairs=4)):
        got = rows(rank_documents(docs(texts).repartition(5), items_of(spark, items), config))
        assert got == brute(texts, items, config.k)


def test_empty_tables(spark, docs):
    items = items_of(spark, [(1, "a b")])
    assert rank_documents(docs([]), items).count() == 0
    assert rank_documents(docs([(1, "a")]), items_of(spark, [])).count() == 0
    assert rows(rank_documents(docs([(1, "a")]), items)) == brute([(1, "a")], [(1, "a b")], 10)


@pytest.mark.parametrize("seed", range(5))
def test_slices_add_and_select(seed):
    """Sums of bit slices against plain sums, with rare and frequent terms and large impacts."""
    rng = np.random.default_rng(seed)
    n = 1000
    impacts = {t: np.where(rng.random(n) < share, rng.integers(1, 1 << bits, n), 0) for t, (share, bits) in enumerate([(1.0, 35), (0.9, 20), (0.3, 3), (0.004, 35), (0.5, 1)])}
    impacts[0][::3] = impacts[0][0]  # ties
    row, term, impact = (np.concatenate(x) for x in zip(*((np.flatnonzero(v), np.full((v > 0).sum(), t), v[v > 0]) for t, v in impacts.items())))
    slices = Slices(n, term, row, impact)
    rank = rng.permutation(n)
    for wanted in ([0], [1, 2], [3], [0, 1, 2, 3, 4], [9], []):
        plain = sum((impacts[t] for t in wanted if t in impacts), np.zeros(n, np.int64))
        total = slices.add(wanted)
        for k in (1, 10, 400, 2000):
            place, score = top(total, k, rank)
            order = sorted(np.flatnonzero(plain), key=lambda p: (-plain[p], rank[p]))[:k]
            assert sorted(place.tolist()) == sorted(order)
            assert score.tolist() == plain[place].tolist()
