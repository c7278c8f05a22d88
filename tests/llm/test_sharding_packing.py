import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from nearvote.llm import common
from nearvote.llm.packing import PackingConfig, optimal_boundaries, pack
from nearvote.llm.sharding import assign_shards, jump
from tests.llm.conftest import words


def plain_jump(key, shards):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 300)
    for shards in (1, 2, 8, 9, 1000):
        assert jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_appended_shards_only_take():
    keys = np.arange(50_000)
    for shards in (1, 8, 20):
        now, grown = jump(keys, shards), jump(keys, shards + 1)
        moved = now != grown
        assert (grown[moved] == shards).all()
        assert abs(moved.mean() - 1 / (shards + 1)) < 0.01
        assert max(Counter(now.tolist()).values()) < 1.1 * 50_000 / shards


def test_shards_of_odd_texts(docs, odd_texts):
    rows = odd_texts + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]
    got = assign_shards(docs(rows)).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        key = r["doc_id"] or 0
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", plain_jump(key, 8), plain_jump(key, 9))
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == want
    assert assign_shards(docs([])).count() == 0


@pytest.mark.parametrize("groups", [4, 10**6])
def test_gapless_numbers_every_group(spark, groups):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(500)], "g int, k long")
    got = {}
    for r in common.gapless(df, "g", "k", "at", groups).collect():
        got.setdefault(r["g"], []).append(r["at"])
    assert len(got) == 4 and all(sorted(v) == list(range(len(v))) for v in got.values())


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.unique(rng.integers(0, 60, rng.integers(1, 10)))
        counts = rng.integers(1, 20, len(lengths))
        for buckets in (1, 2, 3, 20):
            got = optimal_boundaries(lengths, counts, buckets)
            assert len(got) <= buckets and got[-1] == lengths[-1]
            choices = (list(c) + [int(lengths[-1])] for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1].tolist(), k))
            assert padding(lengths, counts, got) == min(padding(lengths, counts, c) for c in choices)
    assert optimal_boundaries(np.zeros(0), np.zeros(0), 4) == []


def test_pack(docs, odd_texts):
    rows = odd_texts + [(100 + i, "w " * (i % 37)) for i in range(300)] + [(100, "twice")]
    got = pack(docs(rows), PackingConfig(buckets=4, budget=256)).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(words(t)) for _, t in rows)
    batches = {}
    for r in got:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    tops = sorted({(r["bucket"], r["bucket_length"]) for r in got})
    assert [b for b, _ in tops] == list(range(len(tops)))
    lengths, counts = np.unique([r["n_tokens"] for r in got], return_counts=True)
    assert [t for _, t in tops] == optimal_boundaries(lengths, counts, 4)
    last = {b: max(x for y, x in batches if y == b) for b, _ in tops}
    for (bucket, batch), own in batches.items():
        length = own[0]["bucket_length"]
        room = max(1, 256 // max(1, length))
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == room or (batch == last[bucket] and len(own) <= room)
    assert pack(docs([])).count() == 0
