import math
import random

import numpy as np
import pyarrow as pa

from nearvote.llm.decontamination import BITS, SKETCH_CELLS, SKETCH_ROWS, DecontaminationConfig, Frequencies, Index, MultiIndex, blocks, contaminated, matches, simhash
from tests.llm.conftest import words


def shingle_list(w, k):
    n = min(k, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def brute(docs, items, k=5, threshold=0.8):
    """Every window of every item's length, by the exact weighted similarity alone."""
    bags, df = {}, {}
    known = [(i, words(t)) for i, t in items if words(t)]
    for _, w in known:
        for s in set(shingle_list(w, k)):
            df[s] = df.get(s, 0) + 1
    n = len(known)

    def bag(w):
        out = {}
        for s in shingle_list(w, k):
            out[s] = out.get(s, 0) + math.log1p(n / df[s] if s in df else n)
        return out

    bags = {i: (len(w), bag(w)) for i, w in known}
    found = {}
    for d, t in docs:
        w = words(t)
        for i, (length, own) in bags.items():
            length = min(length, len(w))
            for a in range(len(w) - length + 1 if w else 0):
                other = bag(w[a : a + length])
                shared = sum(min(v, other[s]) for s, v in own.items() if s in other)
                total = sum(own.values()) + sum(other.values()) - shared
                if total and shared / total >= threshold:
                    found[d, i] = max(found.get((d, i), 0), shared / total)
    return found


def planted(rng, n_docs=60):
    pool = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(14, 60)))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "only three words"), (23, items[0][1])]
    docs = []
    for d in range(n_docs):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            part = words(rng.choice(items[:20])[1])
            if d % 2:
                part[rng.randrange(len(part))] = "edited"
            if d % 4 == 0:
                part.insert(rng.randrange(len(part)), "new")
            w = w[:50] + part + w[50:]
        docs.append((d, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, items[3][1]), (1003, items[4][1].upper() + " x"), (1004, "Only THREE words"), (1005, " ".join(words(items[5][1])[:12]))]
    return docs, items


def test_equals_brute_force(spark, docs):
    for seed in (1, 2):
        rows, items = planted(random.Random(seed))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(docs(rows), bench).collect()}
        want = brute(rows, items)
        assert len(want) > 10 and set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_reordered_and_repeated_passages_equal_brute_force(spark, docs):
    rng = random.Random(6)
    rows, items = planted(rng, 0)
    items += [(30, " ".join(["la"] * 30)), (31, " ".join(words(items[1][1]) * 2)), (32, " ".join(f"s{i}" for i in range(60)))]
    for d in range(100, 160):
        w = words(rng.choice(items[:20] + items[24:])[1])
        cut = rng.randrange(1, len(w)) if d % 3 else len(w) // 2
        before, after = ([f"n{rng.randrange(500)}" for _ in range(rng.randrange(0, 90))] for _ in range(2))
        rows.append((d, " ".join(before + w[cut:] + w[:cut] + after)))
    swapped = [f"s{i}" for i in [*range(30, 60), *range(30)]]
    rows += [(200, " ".join(["x"] * 70 + swapped + ["y"] * 70)), (201, " ".join(["la"] * 300)), (203, "la la la la la la"), (202, " ".join(words(items[1][1]) * 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(docs(rows), bench).collect()}
    want = brute(rows, items)
    assert (200, 32) in want and (201, 30) in want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def found(df):
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in df.collect()}


def test_blocks_of_the_benchmark_change_nothing(spark, docs):
    """Items share openings and ends, and passages lie about the threshold."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    opening, end = [[rng.choice(pool) for _ in range(8)] for _ in range(2)]
    items = [(i, " ".join(opening + [rng.choice(pool) for _ in range(30)] + end)) for i in range(30)]
    rows = []
    for d in range(60):
        part = words(items[d % 30][1])
        for _ in range(d % 3):
            part[rng.randrange(len(part))] = f"e{d}"
        rows.append((d, " ".join([rng.choice(pool) for _ in range(20)] + part + [rng.choice(pool) for _ in range(20)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (found(contaminated(docs(rows), bench, DecontaminationConfig(block_bytes=n))) for n in (1 << 20, 900))
    want = brute(rows, items)
    assert one == many and set(one) == set(want) and len(one) > 20
    assert any(0.8 <= x < 0.85 for x in one.values())


def test_template_items_with_words_put_in(spark, docs):
    """The best window stands at no place where a shingle of document and item meet."""
    rng = random.Random(11)
    opening, end = [f"a{i}" for i in range(5)], [f"z{i}" for i in range(5)]
    items = [(i, " ".join(opening + [f"i{i}-{j}" for j in range(40)] + end)) for i in range(100)]
    w = words(items[42][1])
    rows = [(d, " ".join([f"n{d}-{j}" for j in range(30)] + w[:at] + ["new1", "new2"] + w[at:] + [f"m{d}-{j}" for j in range(30)])) for d, at in enumerate(range(3, 48, 4))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, want = found(contaminated(docs(rows), bench)), brute(rows, items)
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_multi_index_lookup():
    rng = random.Random(12)
    prints = [rng.getrandbits(BITS) for _ in range(200)]
    index = MultiIndex(prints, 4)
    for i, p in enumerate(prints):
        near = p ^ sum(1 << b for b in rng.sample(range(BITS), 3))
        assert index.near(p, i) and index.near(near, i)
        assert index.near(rng.getrandbits(BITS), i) in (False, True)
    assert not any(index.near(p ^ ((1 << BITS) - 1), i) for i, p in enumerate(prints))
    assert not MultiIndex([], 4).near(0, 0)


def test_multi_index_misses_no_fingerprint_within_the_radius():
    rng = random.Random(4)
    for radius in (3, 22):
        for _ in range(300):
            a = rng.getrandbits(BITS)
            b = a
            for bit in rng.sample(range(BITS), radius):
                b ^= 1 << bit
            assert set(blocks(a, radius + 1)) & set(blocks(b, radius + 1))


def test_similar_bags_have_near_fingerprints():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.integers(0, 2**63, 40).astype(np.uint64)
        t = s.copy()
        t[:4] = rng.integers(0, 2**63, 4).astype(np.uint64)  # a similarity of 36 / 44
        w = np.ones(40)
        assert (simhash(s, w) ^ simhash(t, w)).bit_count() <= DecontaminationConfig().radius


def test_empty_tables_and_repeats(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g")], "item_id long, text string")
    assert contaminated(docs([]), bench).count() == 0
    assert contaminated(docs([(1, "a b c d e f g")]), bench.limit(0)).count() == 0
    got = contaminated(docs([(5, "x a b c d e f g"), (5, "x a b c d e f g"), (None, "a b c d e f g")]), bench).collect()
    assert {r["doc_id"] for r in got} == {5, None} and all(r["similarity"] == 1 for r in got)
    assert Index([], [], DecontaminationConfig(), Frequencies(0, np.zeros((2, 1 << 20), np.uint32))).sizes == []


def test_a_template_that_all_items_share_stays_small():
    """8,000 items with one opening and a long text of that opening: memory follows hits, not pairs."""
    import tracemalloc

    opening = "answer the following question now"
    items = [f"{opening} " + " ".join(f"q{i}w{j}" for j in range(12)) for i in range(8000)]
    texts = [" ".join([opening] * 2000), f"x {items[77]} y", f"{opening} something else"]
    config = DecontaminationConfig()
    index = Index(list(range(8000)), items, config, Frequencies(8000, np.zeros((SKETCH_ROWS, SKETCH_CELLS), np.uint32)))
    column = pa.array(texts)
    tracemalloc.start()
    found = [(row, item) for row, item, *_ in matches(index, column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1, 77)]
    assert peak < 100 << 20
