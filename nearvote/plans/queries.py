"""The registered queries of the risk engine. Each has its SQL twin in plans.sql."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.config import ScoringConfig
from nearvote.functions import scores
from nearvote.functions.vector import partial_distance, profile_key, quantize, text_of
from nearvote.operators import cells, evaluate, features, generate, index, ivf, kmeans, kmknn, knn, knn_kernel, routed
from nearvote.plans import views
from nearvote.plans.views import CLUSTERS, DIMS
from nearvote.sources.index_store import open_index, write_index
from nearvote.sources.readers import table
from nearvote.sources.scratch import scratch_dir, stored
from nearvote.streaming import append, scoring
from nearvote.streaming.warmup import warm_up

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NPROBE = 2
#: Least profile count where the tables are small.
MIN_COUNT = 3


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


@query
def exact_knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    return knn.vote(knn.nearest(views.queries(refs), refs, 5, DIMS))


@query
def exact_knn_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    return knn.nearest(views.queries(refs), refs, 5, DIMS).select("qid", "rk", "ref_id", "fraud", _round("d"))


@query
def exact_knn_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours by the numpy kernel."""
    refs = views.references(spark, sf)
    return knn_kernel.nearest(views.queries(refs), refs, 5, DIMS).select("qid", "rk", "ref_id", "fraud", _round("d"))


@query
def quantize_vectors(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.fixed(views.references(spark, sf))
    return refs.select("ref_id", text_of(F.col("vec")).alias("q"), "fraud")


def _fixed_top(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    refs = views.references(spark, sf)
    return refs, knn.nearest(views.fixed_queries(refs), views.fixed(refs), k, DIMS)


@query
def int16_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_top(spark, sf, 6)[1].select("qid", "rk", "ref_id", "fraud", F.col("d").cast("long").alias("d"))


@query
def knn_rerank_5of6(spark: SparkSession, sf: str) -> DataFrame:
    refs, six = _fixed_top(spark, sf, 6)
    return knn.vote(knn.rerank(six, views.queries(refs), refs, DIMS))


@query
def rerank_skip_split(spark: SparkSession, sf: str) -> DataFrame:
    refs, six = _fixed_top(spark, sf, 6)
    return evaluate.path_counts(knn.decide(six, views.queries(refs), refs, DIMS))


@query
def knn_agreement(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    return evaluate.agreement(exact_knn_vote(spark, sf), knn.vote(knn.nearest(views.fixed_queries(refs), views.fixed(refs), 5, DIMS)))


@query
def knn_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 queries on which three voters and five disagree."""
    refs = views.references(spark, sf)
    found = knn.nearest(views.queries(refs), refs, 5, DIMS)
    three = found.where("rk <= 3").groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count")).withColumn("approved", F.col("fraud_count") < 2)
    return evaluate.disagreements(knn.vote(found), three)


@query
def kmeans_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.seeds(views.references(spark, sf), CLUSTERS).select("cluster_id", "ref_id")


@query
def kmeans_assign_once(spark: SparkSession, sf: str) -> DataFrame:
    _, assigned, _ = views.one_step(views.references(spark, sf))
    return assigned.select("ref_id", "cluster_id", _round("d"))


@query
def kmeans_recompute_once(spark: SparkSession, sf: str) -> DataFrame:
    _, assigned, _ = views.one_step(views.references(spark, sf))
    means = kmeans.recompute(assigned, CLUSTERS, DIMS)
    return means.select("cluster_id", "cnt", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 9))


@query
def kmeans_seeded_argmin(spark: SparkSession, sf: str) -> DataFrame:
    """Size and inertia of every cluster after the first assignment."""
    _, assigned, _ = views.one_step(views.references(spark, sf))
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("cnt"), F.round(F.sum("d"), 6).alias("inertia"))


@query
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    centroids, assigned = kmeans.fit(views.references(spark, sf), CLUSTERS, DIMS, iterations=5)
    sizes = kmeans.offsets(assigned, CLUSTERS)
    return sizes.join(centroids, "cluster_id").select("cluster_id", "cnt", "start", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query
def kmeans_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and centroids after two Lloyd rounds."""
    centroids, assigned = kmeans.fit(views.references(spark, sf), CLUSTERS, DIMS, iterations=2)
    sizes = kmeans.offsets(assigned, CLUSTERS).select("cluster_id", "cnt")
    flat = centroids.select("cluster_id", F.posexplode("centroid").alias("dim", "mean"))
    return flat.join(sizes, "cluster_id").select("cluster_id", "cnt", "dim", _round("mean", 6))


@query
def cluster_bbox(spark: SparkSession, sf: str) -> DataFrame:
    _, _, clusters = views.one_step(views.references(spark, sf))
    return clusters.select("cluster_id", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "box")).select("cluster_id", "dim", "box.low", "box.high")


@query
def cluster_radius(spark: SparkSession, sf: str) -> DataFrame:
    _, _, clusters = views.one_step(views.references(spark, sf))
    return clusters.select("cluster_id", "cnt", "radius")


@query
def cluster_offsets(spark: SparkSession, sf: str) -> DataFrame:
    _, assigned, _ = views.one_step(views.references(spark, sf))
    return kmeans.offsets(assigned, CLUSTERS)


@query
def cluster_slots(spark: SparkSession, sf: str) -> DataFrame:
    _, assigned, _ = views.one_step(views.references(spark, sf))
    return kmeans.slots(assigned).select("ref_id", "cluster_id", "slot")


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    return refs, assigned, clusters, ivf.bound_table(views.fixed_queries(refs), clusters, DIMS)


@query
def bbox_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Every query's bound for every cluster."""
    return _pairs(spark, sf)[3].select("qid", "cluster_id", F.col("box").alias("lb"), "dc")


@query
def partial_distances(spark: SparkSession, sf: str) -> DataFrame:
    """First and last eight dimensions of some pairs, as an early exit would see them."""
    refs = views.fixed(views.references(spark, sf))
    some = refs.where("ref_id % 100 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    a, b = F.col("qv"), F.col("vec")
    pairs = refs.crossJoin(F.broadcast(some)).where("qid <> ref_id")  # queries: a hundredth of the references
    return pairs.select("qid", "ref_id", partial_distance(a, b, 0, 8).cast("long").alias("head"), partial_distance(a, b, DIMS - 8, 8).cast("long").alias("tail"))


@query
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn query vectors scored by the exact kernel and by repaired inverted-file search."""
    known = stored(_event_vectors(spark, sf))
    drawn = generate.query_vectors(spark, 10_000, seed=42)
    exact = knn.vote(knn_kernel.nearest(drawn, known, 5, 14, exclude_self=False))
    members, clusters = _event_index(known)
    found = ivf.score(drawn, known, members, clusters, 14, ScoringConfig(nprobe=4), exclude_self=False)
    return evaluate.agreement(exact, found)


@query
def probe_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)[3].where(F.col("probe") <= NPROBE).select("qid", "cluster_id", "probe")


@query
def unprobed_anti(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that are not probed, by an anti join."""
    order = _pairs(spark, sf)[3]
    probed = order.where(F.col("probe") <= NPROBE).select("qid", "cluster_id")
    return order.select("qid", "cluster_id").join(probed, ["qid", "cluster_id"], "left_anti")


@query
def triangle_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: unprobed clusters, and those left by the triangle and the box bound."""
    refs, assigned, clusters, order = _pairs(spark, sf)
    first = ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE, repair=False)
    worst = first.groupBy("qid").agg(F.when(F.count("*") >= 6, F.max("d")).alias("worst"))
    left = F.col("worst").isNull() | (F.greatest("triangle", "box") <= F.col("worst"))
    return order.where(F.col("probe") > NPROBE).join(worst, "qid", "left").groupBy("qid").agg(F.count("*").alias("unprobed"), F.count_if(left).alias("survivors"))


@query
def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    found = ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE)
    return found.select("qid", "rk", "ref_id", F.col("d").cast("long").alias("d"))


@query
def ivf_score(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    return ivf.score(views.queries(refs), refs, views.members(assigned), clusters, DIMS, ScoringConfig(nprobe=NPROBE))


@query
def search_counters(spark: SparkSession, sf: str) -> DataFrame:
    """(query, cluster) pairs that a repaired search probes, scans again and prunes."""
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    stats = ivf.SearchStats()
    ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE, stats=stats)
    return spark.createDataFrame([(stats.probed, stats.repaired, stats.pruned)], "probed long, repaired long, pruned long")


@query
def ivf_routed(spark: SparkSession, sf: str) -> DataFrame:
    """The search with queries shuffled to the clusters, as it runs for more of them than a broadcast holds."""
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    found = ivf.search_routed(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE)
    return found.select("qid", "rk", "ref_id", F.col("d").cast("long").alias("d"))


@query
def index_score(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of an index in fixed point, written, opened with its companion of exact vectors, and
    searched by routed queries; only the rerank reads floats."""
    refs = views.references(spark, sf)
    path = scratch_dir(spark)
    write_index(refs, path, "ivf", DIMS, k=CLUSTERS, iterations=1, nprobe=NPROBE, files=4, exact=f"{path}-exact")
    opened = open_index(spark, path, f"{path}-exact")
    return opened.score(views.queries(refs), replace(ScoringConfig(nprobe=NPROBE), block_bytes=1), exclude_self=True)


@query
def repair_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """What the rounds of a routed search scan and prune, observed while it runs."""
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    seen = routed.RoutedStats()
    ivf.search_routed(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE, seen=seen)
    row = (seen.pairs[0], sum(seen.pairs[1:]), seen.coarse, seen.fine, seen.measured)
    return spark.createDataFrame([row], "probed long, repaired long, by_triangle long, by_box long, measured long")


@query
def ivf_unrepaired(spark: SparkSession, sf: str) -> DataFrame:
    """The probed clusters only: what is found without repair."""
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    found = ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE, repair=False)
    return found.select("qid", "rk", "ref_id", F.col("d").cast("long").alias("d"))


@query
def ivf_repair_equals_brute(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that repaired search and brute force do not share, over three numbers of probes."""
    refs, brute = _fixed_top(spark, sf, 6)
    _, assigned, clusters = views.one_step(refs)
    out = None
    for nprobe in (1, 2, 8):
        found = ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, nprobe)
        both = found.join(brute.select("qid", "rk", F.col("ref_id").alias("other")), ["qid", "rk"], "full")
        row = both.agg(F.lit(nprobe).alias("nprobe"), F.count("*").alias("n"), F.count_if(~F.col("ref_id").eqNullSafe(F.col("other"))).alias("different"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def kmknn_search(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    return kmknn.score(views.queries(refs), views.members(assigned), clusters, DIMS, ScoringConfig(nprobe=NPROBE, nprobe_full=4))


def _event_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(ref_id, fraud, vec) of the events."""
    rows = features.featurize(views.event_requests(spark, sf))
    return rows.select(F.col("event_id").alias("ref_id"), "fraud", F.col("vec").cast("array<double>").alias("vec"))


@query
def features_from_events(spark: SparkSession, sf: str) -> DataFrame:
    v = _event_vectors(spark, sf)
    return v.select(F.col("ref_id").alias("event_id"), *(F.get("vec", F.lit(i)).alias(f"f{i}") for i in range(14)))


@query
def features_from_orders(spark: SparkSession, sf: str) -> DataFrame:
    v = features.featurize(views.order_requests(spark, sf))
    return v.select("o_orderkey", *(F.get("vec", F.lit(i)).cast("double").alias(f"f{i}") for i in range(14)))


@query
def profile_keys(spark: SparkSession, sf: str) -> DataFrame:
    v = _event_vectors(spark, sf)
    return v.select("ref_id", profile_key(quantize(F.col("vec"))).alias("pkey"))


@query
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    return index.profile_table(_event_vectors(spark, sf))


@query
def profile_census(spark: SparkSession, sf: str) -> DataFrame:
    return index.profile_census(index.profile_table(_event_vectors(spark, sf)))


@query
def profile_score(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the profile shortcut for every 50th event, from the other events' table."""
    v = _event_vectors(spark, sf)
    known = index.profile_table(v.where("ref_id % 50 <> 0"))
    looked = index.profile_verdicts(v.where("ref_id % 50 = 0"), known, MIN_COUNT)
    count = F.col("profile_count")
    return looked.select("ref_id", "pkey", count.alias("fraud_count"), scores.approved(count).alias("approved"))


@query
def unanimity_skip_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many queries each shortcut of the repair would skip after the first pass."""
    refs = views.references(spark, sf)
    _, assigned, clusters = views.one_step(refs)
    first = ivf.search(views.queries(refs), views.members(assigned), clusters, DIMS, 6, NPROBE, repair=False)
    state = first.groupBy("qid").agg(F.sum("fraud").alias("frauds"), F.count("*").alias("found"))
    full = F.col("found") == 6
    return state.agg(F.count("*").alias("n"), F.count_if(full & F.col("frauds").isin(0, 6)).alias("unanimous"), F.count_if(full & ((F.col("frauds") <= 1) | (F.col("frauds") >= 5))).alias("deterministic"))


def _event_index(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of event vectors after one assignment to the seeds."""
    centroids = views.fetched(kmeans.seeds(known, CLUSTERS).select("cluster_id", "centroid"))
    assigned = kmeans.assign(known, centroids, 14)
    return views.members(assigned), views.fetched(index.cluster_stats(assigned, centroids, 14))


#: Event vectors from which on they are kept in cells, whose number grows with theirs.
CELLS_FROM = 1 << 17


def _event_members(known: DataFrame) -> tuple[DataFrame | cells.Cells, DataFrame | None]:
    """What ``ivf.search`` finds fixed event vectors in: a few clusters, or cells."""
    if known.count() > CELLS_FROM:
        return cells.build(views.fixed(known), 14), None
    return _event_index(known)


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and accuracy of the profile shortcut by threshold, for every 50th event against
    all others: where the profile misses, repaired search in fixed point decides. The expected
    verdict is the event's label."""
    v = stored(_event_vectors(spark, sf))
    known = v.where("ref_id % 50 <> 0")
    tested = v.where("ref_id % 50 = 0")
    members, clusters = _event_members(known)
    queries = tested.select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    verdicts = knn.vote(ivf.search(queries, members, clusters, 14, 5, nprobe=4, exclude_self=False))
    looked = index.with_profile(tested, index.profile_table(known))
    rows = looked.join(verdicts.select(F.col("qid").alias("ref_id"), "approved"), "ref_id")
    return evaluate.threshold_sweep(rows.select("mask", "cnt", "approved", (F.col("fraud") == 0).alias("expected")))


def _shown(parsed: DataFrame, *keys: str) -> DataFrame:
    return features.featurize(parsed).select(*keys, *(F.get("vec", F.lit(i)).cast("double").alias(f"f{i}") for i in range(14)))


@query
def features_golden(spark: SparkSession, sf: str) -> DataFrame:
    """A request of fixed shape for every order, with the order's price and number in it."""
    return _shown(features.parse_requests(views.order_payloads(spark, sf)), "o_orderkey", "parse_ok")


@query
def payload_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The events' request documents, each damaged in one of ten ways or left as it is."""
    return _shown(features.parse_requests(views.odd_payloads(spark, sf)), "event_id", "case", "parse_ok")


@query
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    v = F.try_parse_json("props")
    return e.select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "int").alias("missing"))


@query
def merchant_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose merchant is among the customer's known ones, as a semi join."""
    r = views.event_requests(spark, sf)
    known = r.select("event_id", F.explode(F.slice("request.known_merchants", 1, 32)).alias("merchant_id")).distinct()
    return r.select("event_id", F.col("request.merchant_id").alias("merchant_id")).join(known, ["event_id", "merchant_id"], "left_semi")


@query
def mcc_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of every event's category, the default where it is unknown; a few categories are broadcast."""
    from nearvote.config import DEFAULT_RISK, MCC_RISK

    risks = spark.createDataFrame(sorted(MCC_RISK.items()), "mcc string, risk double")
    r = views.event_requests(spark, sf).select("event_id", F.col("request.mcc").alias("mcc"))
    return r.join(F.broadcast(risks), "mcc", "left").select("event_id", F.coalesce("risk", F.lit(DEFAULT_RISK)).alias("risk"))


@query
def payload_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's documents dealt to the orders: every order gets the one of its key."""
    grid = generate.payload_grid(spark, 500)
    dealt = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("i"))
    return _shown(features.parse_requests(dealt.join(F.broadcast(grid), "i")), "o_orderkey", "i", "parse_ok")


@query
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = evaluate.percentiles(table(spark, sf, "events"), "value")
    return p.withColumn("mean", F.round("mean", 6))


@query
def response_json(spark: SparkSession, sf: str) -> DataFrame:
    v = exact_knn_vote(spark, sf)
    return v.select("qid", scores.response(F.col("fraud_count")).alias("response"))


@query
def path_counters(spark: SparkSession, sf: str) -> DataFrame:
    """How the verdicts of profile, skip and rerank paths split over every 50th event."""
    v = stored(_event_vectors(spark, sf))
    known = v.where("ref_id % 50 <> 0")
    members, clusters = _event_members(known)
    tested = v.where("ref_id % 50 = 0").select(F.col("ref_id").alias("qid"), F.col("vec").alias("qv"))
    config = replace(ScoringConfig(), profile=True, profile_min_count=MIN_COUNT, nprobe=4)
    done = ivf.score(tested, known, members, clusters, 14, config, index.profile_table(known))
    return evaluate.path_counts(done)


@query
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th event's request, some of them damaged, as a stream of micro-batches against all
    events."""
    path = scratch_dir(spark)
    refs = stored(_event_vectors(spark, sf))
    views.odd_payloads(spark, sf).where("event_id % 50 = 0").select(F.col("event_id").alias("qid"), "value").write.parquet(f"{path}/in")
    incoming = spark.readStream.schema("qid long, value string").parquet(f"{path}/in")

    def detector(rows: DataFrame) -> DataFrame:
        return knn.vote(knn.nearest(rows, refs, 5, 14, exclude_self=False)).withColumn("path", F.lit("exact"))

    return scoring.run_once(spark, incoming, detector, f"{path}/out", f"{path}/checkpoint").drop("batch")


@query
def features_from_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The events' features by way of request documents: written as JSON and parsed again."""
    return _shown(features.parse_requests(views.event_payloads(spark, sf)), "event_id", "parse_ok")


@query
def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th event's request as a stream in append mode, against all other events."""
    path = scratch_dir(spark)
    known = stored(_event_vectors(spark, sf).where("ref_id % 50 <> 0"))
    views.event_payloads(spark, sf).where("event_id % 50 = 0").select(F.col("event_id").alias("qid"), "value").write.parquet(f"{path}/in")
    incoming = spark.readStream.schema("qid long, value string").parquet(f"{path}/in")
    for running in append.start(incoming, known, f"{path}/out", f"{path}/rejects", f"{path}/checkpoint", once=True):
        running.awaitTermination()
    return spark.read.schema("qid long, parse_ok boolean, path string, fraud_count int, approved boolean, response string").parquet(f"{path}/out").drop("batch")


@query
def warm_up_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a warm-up over the events' damaged documents scores, skips and draws; the other way round
    from serving, every 50th event is a reference."""
    refs = stored(_event_vectors(spark, sf).where("ref_id % 50 = 0"))
    done = warm_up(spark, append.detector(refs), views.odd_payloads(spark, sf), per_slot=5000, slots=4)
    return spark.createDataFrame([(done.scored, done.skipped, done.drawn)], "scored long, skipped long, drawn long")
