import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from nearvote.llm import ppm, text
from nearvote.llm.ppm import LmConfig, Trie, score_texts
from tests.llm.conftest import LOWER, words


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """Prediction by partial matching with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            m = self.message(t)
            for i in range(order, len(m)):
                for k in range(order + 1):
                    self.seen[bytes(m[i - k : i])][m[i]] += 1

    def message(self, t):
        return [255] * self.order + list((t or "").translate(LOWER).encode()) + [255]

    def byte(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.seen.get(bytes(context[len(context) - k :]))
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            n, d = sum(left.values()), len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / (n + d))
            if d:
                out += math.log10(d / (n + d))
            gone |= set(seen)
        return out - math.log10(max(1, 256 - len(gone)))

    def score(self, t):
        m = self.message(t)
        return sum(self.byte(m[i - self.order : i], m[i]) for i in range(self.order, len(m)))


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    parts = ["the", "ing", "und", "é", "que", "A", "x1"]
    return [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 40)))) for i in range(n)]


def check(rows, got, order):
    train = [t for i, t in rows if not held(i)]
    counts = Counter()
    for t in train:
        counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    model = Plain(train, order)
    assert len(got) == len(rows)
    for i, t in rows:
        r, tokens = got[i], [*words(t), None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        want = model.score(t)
        assert abs(r["score"] - want) < 1e-5 * max(1, abs(want)), (i, t)


def test_equals_plain_model(docs):
    rows = corpus() + [(500, None), (501, ""), (502, "  \n"), (503, "\U0001f600 世界 QZ"), (504, "the " * 3000)]
    for order in (2, 4):
        got = {r["doc_id"]: r for r in score_texts(docs(rows), LmConfig(order=order)).collect()}
        check(rows, got, order)


def test_shuffled_word_counts_give_the_same(docs):
    rows = corpus(50, 2) + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in score_texts(docs(rows), LmConfig(order=3, max_words=0)).collect()}
    check(rows, got, 3)
    twice = score_texts(docs([*rows, rows[0]]), LmConfig(order=3, max_words=0))
    assert twice.count() == len(rows) + 1


def test_more_nodes_than_the_bound_give_the_same(docs):
    rows = corpus(50, 3) + [(500, None), (501, ""), (503, "\U0001f600 世界 QZ"), (None, "the x1")]
    for order, max_nodes, max_words in ((4, 50, 1 << 22), (3, 0, 0), (1, 10, 1 << 22), (2, 1 << 21, 20)):
        got = score_texts(docs(rows), LmConfig(order=order, max_nodes=max_nodes, max_words=max_words)).collect()
        assert len(got) == len(rows)
        train = [(i if i is not None else "", t) for i, t in rows]
        check(train, {r["doc_id"] if r["doc_id"] is not None else "": r for r in got}, order)


def test_hot_pairs_of_bytes_are_dealt_by_a_third(docs):
    # A third of all nodes stand after one pair of bytes, at the end of many longer contexts.
    rng = random.Random(9)
    rows = corpus(30, 4) + [(100 + i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) + "e " + rng.choice("klmnop") for _ in range(30))) for i in range(30)]
    for order, max_cell in ((4, 5), (4, 0), (3, 20), (2, 0)):
        got = score_texts(docs(rows), LmConfig(order=order, max_nodes=20, max_cell=max_cell)).collect()
        assert len(got) == len(rows)
        check(rows, {r["doc_id"]: r for r in got}, order)
    # The level below the split one is complete in every task, whatever nodes it holds.
    coded = np.unique(rng.choices(range(1 << 16), k=300) + [0]).astype(np.uint64)
    part, sums = coded[::2], np.ones(len(coded))
    keys, values = ppm._completed(part, np.ones(len(part)), coded, sums)
    assert (keys == coded).all() and (values == sums).all()


def test_probabilities_sum_to_one():
    texts = [t for _, t in corpus(30)]
    data, offsets = text.buffers(pa.array(texts))
    coded, _ = ppm.grams(text.LOWER[data], offsets, 3)
    trie = Trie(*np.unique(coded, return_counts=True), LmConfig(order=3, slot_bits=8))
    for context in (0xFFFFFF, int.from_bytes(b"the", "big"), int.from_bytes(b"qqe", "big"), int.from_bytes(b"zzz", "big")):
        every = np.array([(context << 8) | s for s in range(256)], np.uint64)
        assert abs((10 ** trie.price(every)).sum() - 1) < 1e-6
        assert np.allclose(trie.price(every), trie.walk(every), atol=1e-6)


def test_bounded_trie_keeps_the_most_frequent_nodes(docs):
    rows = docs(corpus()).select("text")
    config = LmConfig(order=4, max_nodes=50)
    trie = ppm.build_trie(ppm.corpus_counts(rows, config), config)
    whole = ppm.build_trie(ppm.corpus_counts(rows, config), LmConfig(order=4))
    assert 0 < len(trie.keys[4]) <= 50 < len(whole.keys[4])
    least = trie.values[4].min()
    assert (whole.values[4] >= least).sum() == len(trie.keys[4])


def test_empty_table_and_no_training_rows(docs):
    assert score_texts(docs([])).count() == 0
    only = next(i for i in range(100) if held(i))
    (r,) = score_texts(docs([(only, "ab")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 0, 0)
    assert abs(r["score"] - 3 * math.log10(1 / 256)) < 1e-9 and r["base_score"] == 0
    assert score_texts(docs([(None, "x"), (None, None)])).count() == 2
