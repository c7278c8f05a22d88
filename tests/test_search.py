from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.functions.vector import PROFILE_LAYOUT, box_bound, bucket, profile_key, quantize, squared_distance
from nearvote.operators import evaluate, index, ivf, kmeans, kmknn, knn, knn_kernel, routed
from nearvote.sources.index_store import open_index, write_index
from nearvote.sources.scratch import stored

DIMS = 14


@pytest.fixture(scope="module")
def world(spark):
    """200 references in four clouds and their cluster structure."""
    rng = np.random.default_rng(42)
    centres = rng.random((4, DIMS))
    vecs = np.round(np.clip(centres[np.arange(200) % 4] + rng.uniform(-0.05, 0.05, (200, DIMS)), -1, 1), 4)
    frauds = rng.integers(0, 2, 200)
    rows = [(i, v.tolist(), int(f)) for i, (v, f) in enumerate(zip(vecs, frauds))]
    refs = spark.createDataFrame(rows, "ref_id long, vec array<double>, fraud int").cache()
    queries = spark.createDataFrame([(1000 + i, np.round(rng.random(DIMS), 4).tolist()) for i in range(20)], "qid long, qv array<double>").cache()
    return vecs, frauds, refs, queries


def brute(vecs, query, k):
    d = ((vecs - query) ** 2).sum(axis=1)
    return np.lexsort((np.arange(len(d)), d))[:k]


def fixed(x):
    return np.clip(np.rint(np.asarray(x) * 4096), -32768, 32767)


def test_exact_search_and_vote(world):
    vecs, frauds, refs, queries = world
    found = knn.nearest(queries, refs, 5, DIMS)
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r["qid"], {})[r["rk"]] = r["ref_id"]
    for q in queries.collect():
        want = brute(vecs, np.array(q["qv"]), 5)
        assert [by_query[q["qid"]][k] for k in range(1, 6)] == want.tolist()
    for r in knn.vote(found).collect():
        want = int(frauds[list(by_query[r["qid"]].values())].sum())
        assert (r["fraud_count"], r["approved"]) == (want, want < 3)


def test_blocks_of_queries_give_the_same(world):
    _, _, refs, queries = world
    whole = sorted(map(tuple, knn.nearest(queries, refs, 3, DIMS).collect()))
    small = knn.nearest(queries, refs, 3, DIMS, ScoringConfig(block_bytes=500))
    assert sorted(map(tuple, small.collect())) == whole


def test_kernel_equals_the_expression(spark, world):
    _, _, refs, queries = world
    want = sorted((r["qid"], r["rk"], r["ref_id"], r["d"]) for r in knn.nearest(queries, refs, 7, DIMS).collect())
    for size in (1 << 20, 500):  # references broadcast, queries in blocks
        got = knn_kernel.nearest(queries, refs, 7, DIMS, ScoringConfig(block_bytes=size)).collect()
        assert sorted((r["qid"], r["rk"], r["ref_id"], r["d"]) for r in got) == want
    # Many equal distances, fewer references than k, the query itself left out
    same = spark.createDataFrame([(i, [float(i % 2)] * 3, i % 2) for i in range(40)], "ref_id long, vec array<double>, fraud int")
    own = same.select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    for k, table in ((4, same), (9, same.where("ref_id < 5"))):
        want = sorted((r["qid"], r["rk"], r["ref_id"]) for r in knn.nearest(own, table, k, 3).collect())
        assert sorted((r["qid"], r["rk"], r["ref_id"]) for r in knn_kernel.nearest(own, table, k, 3).collect()) == want
    assert knn_kernel.nearest(queries.limit(0), refs, 3, DIMS).count() == 0


@pytest.mark.parametrize(("k", "nprobe"), [(4, 1), (7, 2), (1, 1)])
def test_repaired_search_equals_brute_force(spark, world, k, nprobe):
    vecs, _, refs, queries = world
    centroids, assigned = kmeans.fit(refs, k, DIMS, iterations=2)
    clusters = index.cluster_stats(assigned, centroids, DIMS)
    members = assigned.select("ref_id", "fraud", "cluster_id", quantize(F.col("vec")).alias("q"))
    got = {(r["qid"], r["rk"]): r["ref_id"] for r in ivf.search(queries, members, clusters, DIMS, 6, nprobe).collect()}
    for q in queries.collect():
        want = brute(fixed(vecs), fixed(q["qv"]), 6)
        assert [got[q["qid"], i] for i in range(1, 7)] == want.tolist()


def test_cluster_stats_hold_their_members(spark, world):
    vecs, _, refs, _ = world
    centroids, assigned = kmeans.fit(refs, 5, DIMS, iterations=1)
    stats = {r["cluster_id"]: r for r in index.cluster_stats(assigned, centroids, DIMS).collect()}
    assert sum(r["cnt"] for r in stats.values()) == 200
    for r in assigned.collect():
        s, q = stats[r["cluster_id"]], fixed(r["vec"])
        assert (q >= s["low"]).all() and (q <= s["high"]).all()
        assert ((q - s["centroid"]) ** 2).sum() <= s["radius"] ** 2
    starts = kmeans.offsets(assigned, 5).orderBy("cluster_id").collect()
    assert [r["start"] for r in starts] == np.cumsum([0] + [r["cnt"] for r in starts])[:-1].tolist()


def test_kmeans_seeds_and_empty_clusters(spark):
    refs = spark.createDataFrame([(i, [float(i // 2), 0.0], 0) for i in range(6)], "ref_id long, vec array<double>, fraud int")
    assert [(r["cluster_id"], r["ref_id"]) for r in kmeans.seeds(refs, 3).orderBy("cluster_id").collect()] == [(0, 0), (1, 2), (2, 4)]
    same = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(4)], "ref_id long, vec array<double>, fraud int")
    centroids, assigned = kmeans.fit(same, 2, 2, iterations=1)
    rows = {r["cluster_id"]: r["centroid"] for r in centroids.collect()}
    assert rows == {0: [1.0, 1.0], 1: [0.0, 0.0]}  # ties go to cluster 0; an empty cluster is zero
    assert {r["cluster_id"] for r in assigned.collect()} == {0}


def test_bound_never_exceeds_the_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        a, b = rng.integers(-4096, 4096, (2, 6))
        p = rng.integers(np.minimum(a, b), np.maximum(a, b) + 1)
        rows.append((rng.integers(-4096, 4096, 6).tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), p.tolist()))
    df = spark.createDataFrame(rows, "q array<long>, lo array<long>, hi array<long>, p array<long>")
    bad = df.where(box_bound(F.col("q"), F.col("lo"), F.col("hi")) > squared_distance(F.col("q"), F.col("p"), 6))
    assert bad.count() == 0
    folded = squared_distance(F.col("q").cast("array<double>"), F.col("p").cast("array<double>"))
    assert df.where(folded != squared_distance(F.col("q"), F.col("p"), 6)).count() == 0


def test_quantize_clamps_and_buckets(spark):
    df = spark.createDataFrame([([40000.0, -9.0, 0.5, 1.0, 1.5 / 4096, 2.5 / 4096],)], "v array<double>")
    assert df.select(quantize(F.col("v"))).first()[0] == [32767, -32768, 2048, 4096, 2, 2]
    got = spark.createDataFrame([(-1,), (0,), (1,), (2048,), (4096,), (9000,)], "x int").select(bucket(F.col("x"), 4)).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3, 3]


def test_profile_key_layout(spark):
    assert sum(w for w, _, _ in PROFILE_LAYOUT) == 22
    ones = [4096] * 14
    cases = {"ones": ones, "none": [0] * 14, "no_last": [0] * 5 + [-4096, -4096] + [0] * 7}
    df = spark.createDataFrame(list(cases.items()), "name string, q array<int>")
    got = {r["name"]: r["k"] for r in df.select("name", profile_key(F.col("q")).alias("k")).collect()}
    assert got == {"ones": (1 << 22) - 1 - (1 << 13), "none": 0, "no_last": 1 << 13}


def test_profile_table_and_verdicts(spark, world):
    _, _, refs, _ = world
    table = index.profile_table(refs).cache()
    assert table.agg(F.sum("cnt")).first()[0] == 200
    census = index.profile_census(table).first()
    assert census["pure_legit"] + census["pure_fraud"] + census["mixed"] + census["empty"] == 1 << 22
    for r in index.profile_verdicts(refs, table, 1).collect():
        if r["profile_count"] is not None:
            assert r["profile_count"] == 5 * r["fraud"]


def test_profile_keys_are_broadcast_up_to_a_bound(spark, world, monkeypatch):
    _, _, refs, _ = world
    table = index.profile_table(refs.where("ref_id % 3 <> 0"))
    empty = spark.createDataFrame([(900, None)], "ref_id long, vec array<double>")
    tested = refs.select("ref_id", F.col("vec").cast("array<double>").alias("vec")).unionByName(empty)
    got = {}
    for bound in (index.BROADCAST_KEYS, 0):
        monkeypatch.setattr(index, "BROADCAST_KEYS", bound)
        looked = index.profile_verdicts(tested, table, 1)
        assert ("BroadcastHashJoin" in looked._jdf.queryExecution().executedPlan().toString()) == (bound > 0)
        got[bound] = sorted(looked.select("ref_id", "pkey", "profile_count").collect(), key=str)
    first, second = got.values()
    assert first == second and len(first) == 201
    masks = {r["pkey"]: (r["mask"], r["cnt"]) for r in table.collect()}
    for r in first:
        mask, cnt = masks.get(r["pkey"], (0, 0))
        assert r["profile_count"] == {1: 0, 2: 5}.get(mask)
    assert index.profile_verdicts(tested, table.where("false"), 1).where("profile_count is not null").count() == 0


def test_kmknn_and_ivf_agree_with_exact_where_all_is_probed(spark, world):
    _, _, refs, queries = world
    centroids, assigned = kmeans.fit(refs, 4, DIMS, iterations=2)
    clusters = index.cluster_stats(assigned, centroids, DIMS)
    members = assigned.select("ref_id", "fraud", "cluster_id", quantize(F.col("vec")).alias("q"))
    exact = knn.vote(knn.nearest(queries, refs, 5, DIMS))
    twice = kmknn.score(queries, members, clusters, DIMS, ScoringConfig(nprobe=4, nprobe_full=4))
    assert evaluate.agreement(exact, twice).first()["agree"] == 20
    full = ivf.score(queries, refs, members, clusters, DIMS, ScoringConfig(nprobe=2))
    row = evaluate.agreement(exact, full).first()
    assert row["agree"] == 20 and row["false_positives"] == row["false_negatives"] == 0
    assert evaluate.disagreements(exact, full).count() == 0
    shortcut = ivf.score(queries, refs, members, clusters, DIMS, ScoringConfig(nprobe=2, unanimity_skip=True, deterministic_skip=True))
    assert shortcut.count() == 20


def test_rerank_skip_keeps_the_verdict(spark):
    rows = spark.createDataFrame([(f, n) for n in range(1, 7) for f in range(n + 1)], "f int, n int")
    for r in rows.select("f", "n", knn.skip_rerank(F.col("f"), F.col("n")).alias("skip")).collect():
        # With five or fewer candidates all are counted; of six any one may be left out.
        counts = {r["f"]} if r["n"] <= 5 else {f for f in (r["f"] - 1, r["f"]) if max(0, r["f"] - 1) <= f <= 5}
        assert r["skip"] == (len({c < 3 for c in counts}) == 1)


def test_percentiles_take_the_floor_rank(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(10, 1001), 1)
    got = evaluate.percentiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v").first()
    s = np.sort(x)
    assert got["n"] == 1001 and got["max"] == s[-1] and got["mean"] == pytest.approx(x.mean())
    assert [got[f"p{p}"] for p in (50, 90, 95, 99)] == [s[int(1001 * p / 100)] for p in (50, 90, 95, 99)]


def test_threshold_sweep(spark):
    rows = spark.createDataFrame([(1, 10, False, True), (2, 1, True, False), (3, 99, True, True), (None, None, False, True)], "mask int, cnt int, approved boolean, expected boolean")
    got = {r["min_count"]: r for r in evaluate.threshold_sweep(rows).collect()}
    assert (got[1]["covered"], got[1]["correct"]) == (2, 3)
    assert (got[50]["covered"], got[50]["correct"], got[50]["false_positives"], got[50]["false_negatives"]) == (0, 1, 2, 1)


def test_stages_and_pairs_are_counted(spark, world):
    _, _, refs, queries = world
    centroids, assigned = kmeans.fit(refs, 7, DIMS, iterations=2)
    clusters = index.cluster_stats(assigned, centroids, DIMS).where("cnt > 0")
    members = assigned.select("ref_id", "fraud", "cluster_id", quantize(F.col("vec")).alias("q"))
    repaired = []
    for config, stages in ((ScoringConfig(nprobe=2), {"centroid", "scan", "repair", "rerank"}), (ScoringConfig(nprobe=2, block_bytes=500), {"scan", "repair", "rerank"})):
        stats = ivf.SearchStats()
        counted = ivf.score(queries, refs, members, clusters, DIMS, config, stats=stats)
        plain = ivf.score(queries, refs, members, clusters, DIMS, config)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
        assert set(stats.seconds) == stages
        assert stats.probed == 40 and stats.probed + stats.repaired + stats.pruned == 20 * clusters.count()
        repaired.append(stats.repaired)
    # The bounds leave after the first pass what the broadcast search scans again; rounds scan less.
    fixed_queries = queries.select("qid", quantize(F.col("qv")).alias("qv"))
    first = ivf.search(queries, members, clusters, DIMS, 6, 2, repair=False)
    worst = first.groupBy("qid").agg(F.when(F.count("*") >= 6, F.max("d")).alias("worst"))
    left = ivf.bound_table(fixed_queries, clusters, DIMS).where("probe > 2").join(worst, "qid").where("worst is null or greatest(triangle, box) <= worst")
    assert left.count() == repaired[0] >= repaired[1]


def test_lower_bounds_hold(spark, world):
    """The triangle's and the box's bound never exceed a member's distance, and equal the expressions."""
    vecs, _, refs, queries = world
    centroids, assigned = kmeans.fit(refs, 5, DIMS, iterations=2)
    clusters = index.cluster_stats(assigned, centroids, DIMS)
    fixed_queries = queries.select("qid", quantize(F.col("qv")).alias("qv"))
    bounds = ivf.bound_table(fixed_queries, clusters, DIMS)
    pairs = bounds.join(fixed_queries, "qid").join(assigned.select("cluster_id", quantize(F.col("vec")).alias("q")), "cluster_id")
    d = squared_distance(F.col("qv"), F.col("q"), DIMS)
    assert pairs.where((F.col("triangle") > d) | (F.col("box") > d)).isEmpty()
    twins = bounds.join(fixed_queries, "qid").join(clusters, "cluster_id")
    wrong = (F.col("box") != box_bound(F.col("qv"), F.col("low"), F.col("high"))) | (F.col("dc") != squared_distance(F.col("qv"), F.col("centroid"), DIMS))
    assert twins.where(wrong).isEmpty()


@pytest.mark.parametrize("exclude_self", [True, False])
def test_routed_search_equals_brute_force(spark, exclude_self):
    """Copies in one hot cluster, cells of every kind, with and without early exits."""
    rng = np.random.default_rng(8)
    vecs = np.round(rng.random((600, DIMS)) * np.repeat(rng.random((6, DIMS)), 100, axis=0), 4)
    vecs[200:400] = vecs[200]
    refs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(vecs)], "ref_id long, vec array<double>, fraud int")
    queries = refs.where("ref_id % 6 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    centroids, assigned = kmeans.fit(refs, 20, DIMS, iterations=2)
    clusters = index.cluster_stats(assigned, centroids, DIMS)
    members = assigned.select("ref_id", "fraud", "cluster_id", quantize(F.col("vec")).alias("q"))
    small = stored(routed.inverted_lists(members.withColumnRenamed("fraud", "mark"), routed.RoutedConfig(block_rows=16)))
    want = sorted(map(tuple, ivf.search(queries, members, clusters, DIMS, 6, 1, exclude_self=exclude_self).select("qid", "rk", "ref_id", "fraud", "d").collect()))
    once = ivf.SearchStats()
    ivf.search(queries, members, clusters, DIMS, 6, 1, exclude_self=exclude_self, stats=once)
    for lists, exit_dims in ((members, 14), (small, 4)):
        stats = routed.RoutedStats()
        got = ivf.search_routed(queries, lists, clusters, DIMS, 6, 1, exclude_self=exclude_self, config=ScoringConfig(early_exit_dims=exit_dims), seen=stats)
        assert sorted(map(tuple, got.select("qid", "rk", "ref_id", "fraud", "d").collect())) == want
        assert stats.pairs[0] == 100 and sum(stats.pairs) + stats.coarse + stats.fine == 100 * clusters.where("cnt > 0").count()
        assert sum(stats.pairs[1:]) < once.repaired  # the bound tightens
        assert stats.measured >= stats.abandoned and (stats.abandoned > 0) == (exit_dims == 4)
    first = sorted(map(tuple, ivf.search(queries, members, clusters, DIMS, 6, 1, repair=False).select("qid", "rk", "ref_id").collect()))
    assert sorted(map(tuple, ivf.search_routed(queries, small, clusters, DIMS, 6, 1, repair=False).select("qid", "rk", "ref_id").collect())) == first
    skipping = ScoringConfig(nprobe=1, unanimity_skip=True, deterministic_skip=True)
    votes = [sorted(map(tuple, ivf.score(queries, refs, small, clusters, DIMS, replace(skipping, block_bytes=b)).select("qid", "approved").collect())) for b in (0, 1 << 20)]
    assert votes[0] == votes[1]


def test_routed_cells_split_queries_and_members(spark):
    """A few lists of one cluster and many queries: cells of 8 queries and 2 list rows."""
    rows = [(i, [i % 37, i % 11], 0, i % 3) for i in range(400)]
    members = spark.createDataFrame([(i, m, c, q) for i, q, c, m in rows], "ref_id long, mark int, cluster_id int, q array<int>")
    plan = routed.RoutedConfig(first=1, block_rows=32, cell_blocks=2, cell_queries=8)
    queries = spark.createDataFrame([(i, [i - 20, 5], 0, [routed.LEAST, 0], [routed.MOST, 60]) for i in range(50)], "qid long, q array<int>, mark int, lows array<long>, highs array<long>")
    metric = routed.InnerProduct(np.array([0]), np.array([[18.0, 5.0]]), np.array([40.0]))
    got = routed.search(queries, routed.inverted_lists(members, plan), metric, 2, 3, slots=2, config=plan)
    want = []
    for i in range(50):
        scores = sorted((-((i - 20) * q[0] + 5 * q[1]), r) for r, q, _, _ in rows if r != i)
        for slot, some in enumerate((scores, [x for x in scores if 0 <= -x[0] <= 60])):
            want += [(i, slot, n + 1, r, -s) for n, (s, r) in enumerate(some[:3])]
    assert sorted(map(tuple, got.select("qid", "slot", "rk", "ref_id", "score").collect())) == want


def test_fit_goes_on_where_it_was_stopped(spark, world, tmp_path, monkeypatch):
    _, _, refs, _ = world
    whole, _ = kmeans.fit(refs, 5, DIMS, iterations=4)
    state, rounds = f"file://{tmp_path}/state", []
    plain = kmeans.recompute

    def counted(*args):
        if len(rounds) == 2:
            rounds.append("stopped")
            raise KeyboardInterrupt
        rounds.append("round")
        return plain(*args)

    monkeypatch.setattr(kmeans, "recompute", counted)
    with pytest.raises(KeyboardInterrupt):
        kmeans.fit(refs, 5, DIMS, iterations=4, state=state)
    again, _ = kmeans.fit(refs, 5, DIMS, iterations=4, state=state)
    assert rounds == ["round", "round", "stopped", "round", "round"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))


def test_nearest_centroid_of_ties_and_copies():
    rng = np.random.default_rng(3)
    table = np.round(rng.random((40, 5)), 1)
    table[20:] = table[:20]  # every centroid twice: the first one wins
    x = np.concatenate([np.round(rng.random((600, 5)), 1), table[:3]])
    places, d = kmeans.nearest_one(x, table)
    far = ((x[:, None, :] - table[None]) ** 2).sum(axis=2)
    assert (places < 20).all() and np.allclose(d, far.min(axis=1))
    assert np.allclose(far[np.arange(len(x)), places], far.min(axis=1))


@pytest.mark.parametrize("kind", ["exact", "ivf", "kmknn"])
def test_index_round_trip(spark, world, tmp_path, kind):
    _, _, refs, queries = world
    path = f"file://{tmp_path}/{kind}"
    write_index(refs, path, kind, DIMS, k=4, iterations=2, nprobe=4, files=2)
    opened = open_index(spark, path)
    assert opened.meta.format == kind and opened.warm() == 200
    scored = opened.score(queries)
    exact = knn.vote(knn.nearest(queries, refs, 5, DIMS))
    assert evaluate.agreement(exact, scored).first()["n"] == 20
    assert evaluate.agreement(exact, scored).first()["agree"] == 20
    routed_too = opened.score(queries, ScoringConfig(nprobe=4, block_bytes=200))
    assert evaluate.agreement(scored, routed_too).first()["agree"] == 20
    opened.release()
    with pytest.raises(ValueError):
        write_index(refs, path, "tree", DIMS)


def test_companion_of_exact_vectors(spark, world, tmp_path):
    _, _, refs, queries = world
    path, exact = f"file://{tmp_path}/index", f"file://{tmp_path}/floats"
    write_index(refs, path, "ivf", DIMS, k=4, iterations=1, nprobe=2, files=2, exact=exact)
    opened = open_index(spark, path, exact)
    assert opened.lists.schema["q"].dataType.simpleString() == "array<smallint>"
    found = ivf.search(queries, opened.lists, opened.clusters, DIMS, 6, 2)
    assert "floats" not in found._jdf.queryExecution().toString() and "double" not in opened.lists.schema.simpleString()
    want = knn.nearest(queries, refs, 5, DIMS)
    assert evaluate.agreement(knn.vote(want), opened.score(queries)).first()["agree"] == 20
    refs.limit(199).write.parquet(f"file://{tmp_path}/short")
    refs.withColumn("vec", F.slice("vec", 1, 13)).write.parquet(f"file://{tmp_path}/narrow")
    for wrong in ("short", "narrow"):
        with pytest.raises(ValueError, match="vectors of 14 dimensions"):
            open_index(spark, path, f"file://{tmp_path}/{wrong}")


def test_exact_search_makes_no_row_per_pair(spark, world):
    """Pairs are measured within tasks: a join of all pairs was sorted on disk."""
    _, _, refs, queries = world
    for size in (1 << 20, 500):  # references broadcast, queries in blocks
        plan = knn.nearest(queries, refs, 3, DIMS, ScoringConfig(block_bytes=size))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_kernel_over_slices_and_batches_equals_brute_force(monkeypatch):
    monkeypatch.setattr(knn_kernel, "COLUMNS", 16)
    monkeypatch.setattr(knn_kernel, "ROWS", 8)
    rng = np.random.default_rng(3)
    r = rng.integers(0, 3, (300, 4)).astype(float)  # many equal distances
    r[7] = np.nan
    rid, fraud, q = rng.permutation(300), rng.integers(0, 2, 300).astype(np.int32), r[20:50]
    qid = rid[20:50]
    best = knn_kernel.Best(qid, q, 6, True)
    for a in range(0, 300, 70):
        best.add(rid[a : a + 70], fraud[a : a + 70], r[a : a + 70])
    at, to, d = knn_kernel.nearest_block(qid, q, rid, r, 6, True)
    assert (best.rid == rid[to]).all() and (best.d == d).all() and (best.row == at).all() and (best.fraud == fraud[to]).all()
    for i in range(30):
        far = ((r - q[i]) ** 2).sum(axis=1)
        far[(rid == qid[i]) | np.isnan(far)] = np.inf
        assert rid[to][at == i].tolist() == rid[np.lexsort((rid, far))[:6]].tolist()
        within = knn_kernel.nearest_block(qid[i : i + 1], q[i : i + 1], rid, r, 6, True, np.array([1.0]))
        assert within[1].tolist() == [x for x, y in zip(to[at == i], d[at == i]) if y <= 1]


def test_null_vectors_take_no_part_in_exact_search(spark):
    refs = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, None, 1), (2, [1.0, 0.0], 0), (3, [3.0, 0.0], 1)], "ref_id long, vec array<double>, fraud int")
    queries = refs.select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    for size in (1 << 20, 20):
        got = knn.nearest(queries, refs, 2, 2, ScoringConfig(block_bytes=size)).collect()
        assert sorted((r["qid"], r["rk"], r["ref_id"]) for r in got) == [(0, 1, 2), (0, 2, 3), (2, 1, 0), (2, 2, 3), (3, 1, 2), (3, 2, 0)]
