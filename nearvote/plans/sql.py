"""DuckDB twins of the registered queries, built from shared pieces."""

from __future__ import annotations

from nearvote.config import MCC_RISK
from nearvote.operators import generate
from nearvote.operators.evaluate import THRESHOLDS
from nearvote.plans import views

K, NPROBE, MIN_COUNT = 16, 2, 3


def dist(a: str, b: str, dims: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {dims + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def fixed(v: str) -> str:
    return f"list_transform({v}, lambda x: greatest(least(round_even(x * 4096, 0), 32767), -32768))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts) + "\n"


EMB = "emb AS (SELECT vec_id AS ref_id, embedding::DOUBLE[] AS vec, CAST(label >= 5 AS INT) AS fraud FROM embeddings)"
FIX = f"fix AS (SELECT ref_id, {fixed('vec')} AS q, fraud FROM emb)"


def pairs(name: str, source: str, v: str) -> str:
    return f"{name} AS (SELECT a.ref_id AS qid, b.ref_id, b.fraud, {dist(f'a.{v}', f'b.{v}')} AS d FROM {source} a JOIN {source} b ON a.ref_id <> b.ref_id WHERE a.ref_id % 10 = 0)"


def top(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rk FROM {source}) WHERE rk <= {k})"


def voted(name: str, source: str, k: int = 5) -> str:
    return f"{name} AS (SELECT qid, CAST(sum(fraud) AS INT) AS fraud_count FROM {source} WHERE rk <= {k} GROUP BY qid)"


def verdict(source: str, *more: str) -> str:
    return f"SELECT qid, fraud_count, {''.join(m + ', ' for m in more)}fraud_count < 3 AS approved, round(fraud_count * 0.2::DOUBLE, 1) AS fraud_score FROM {source}"


EXACT = (EMB, pairs("ep", "emb", "vec"), top("en", "ep", 5), voted("ev", "en"))
SIX = (EMB, FIX, pairs("fp", "fix", "q"), top("six", "fp", 6))
RERANKED = (f"rd AS (SELECT s.qid, s.ref_id, s.fraud, {dist('a.vec', 'b.vec')} AS d FROM six s JOIN emb a ON a.ref_id = s.qid JOIN emb b ON b.ref_id = s.ref_id)", top("rr", "rd", 5), voted("rv", "rr"))
DECIDED = (
    "seen AS (SELECT qid, CAST(sum(fraud) AS INT) AS frauds, count(*) AS found, CAST(sum(CASE WHEN rk <= 5 THEN fraud ELSE 0 END) AS INT) AS first FROM six GROUP BY qid)",
    "sure AS (SELECT *, least(frauds, 5) < 3 OR greatest(0, frauds - (found - 5)) >= 3 AS sure FROM seen)",
    "decided AS (SELECT qid, CASE WHEN sure THEN first ELSE rv.fraud_count END AS fraud_count, CASE WHEN sure THEN 'rerank_skip' ELSE 'rerank' END AS path FROM sure JOIN rv USING (qid))",
)
STEP = (
    EMB,
    f"pos AS (SELECT *, row_number() OVER (ORDER BY ref_id) - 1 AS pos, count(*) OVER () AS n FROM emb)",
    f"seed AS (SELECT CAST(c AS INT) AS cluster_id, ref_id, vec AS centroid FROM pos JOIN range({K}) r(c) ON pos.pos = c * n // {K})",
    f"ad AS (SELECT e.ref_id, e.vec, e.fraud, s.cluster_id, {dist('e.vec', 's.centroid')} AS d FROM emb e, seed s)",
    "asg AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d, cluster_id) = 1)",
)


def lloyd(n: int, members: str) -> tuple[str, ...]:
    """Centroids ``cen{n}`` of the assignment ``members`` and the assignment ``asg{n}`` to them."""
    return (
        f"mean{n} AS (SELECT cluster_id, i, avg(vec[i]) AS x FROM {members}, range(1, 65) r(i) GROUP BY cluster_id, i)",
        f"cen{n} AS (SELECT CAST(c AS INT) AS cluster_id, coalesce(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), list_transform(range(64), lambda i: 0::DOUBLE)) AS centroid FROM range({K}) r(c) LEFT JOIN mean{n} ON cluster_id = c GROUP BY c)",
        f"ad{n} AS (SELECT e.ref_id, e.vec, s.cluster_id, {dist('e.vec', 's.centroid')} AS d FROM emb e, cen{n} s)",
        f"asg{n} AS (SELECT * FROM ad{n} QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d, cluster_id) = 1)",
    )


CLUSTERS = (
    FIX,
    f"cen AS (SELECT cluster_id, {fixed('centroid')} AS c FROM seed)",
    "mem AS (SELECT asg.ref_id, asg.fraud, asg.cluster_id, fix.q, cen.c FROM asg JOIN fix USING (ref_id) JOIN cen USING (cluster_id))",
    f"rad AS (SELECT cluster_id, count(*) AS cnt, CAST(ceil(sqrt(max({dist('q', 'c')}))) AS INT) AS radius FROM mem GROUP BY cluster_id)",
    "box AS (SELECT cluster_id, i - 1 AS dim, min(q[i]) AS low, max(q[i]) AS high FROM mem, range(1, 65) r(i) GROUP BY cluster_id, i)",
    "boxes AS (SELECT cluster_id, list(low ORDER BY dim) AS low, list(high ORDER BY dim) AS high FROM box GROUP BY cluster_id)",
)
PROBES = (
    f"qd AS (SELECT f.ref_id AS qid, f.q AS qv, cen.cluster_id, {dist('f.q', 'cen.c')} AS dc FROM fix f, cen WHERE f.ref_id % 10 = 0)",
    "probes AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dc, cluster_id) AS probe FROM qd)",
)
GAP = "greatest(low[i] - qv[i], 0) + greatest(qv[i] - high[i], 0)"
BOUND = f"list_sum(list_transform(range(1, 65), lambda i: ({GAP}) * ({GAP})))"


def scanned(name: str, condition: str) -> str:
    return f"{name} AS (SELECT p.qid, m.ref_id, m.fraud, {dist('p.qv', 'm.q')} AS d FROM probes p JOIN mem m USING (cluster_id) WHERE {condition} AND p.qid <> m.ref_id)"


def share(x: str, most: float) -> str:
    return f"round_even(greatest(0::DOUBLE, least(1::DOUBLE, ({x}) / {most}::DOUBLE)) * 10000, 0) / 10000"


def as_float(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


RISK_OF = "CASE TRY_CAST(trim(mcc) AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in MCC_RISK.items()) + " ELSE 0.5 END"


def features(last_missing: str = "last_at IS NULL") -> list[str]:
    """SQL of f0 .. f13 over the columns of a request."""
    minutes = "coalesce((epoch(date_trunc('second', requested_at)) - epoch(date_trunc('second', last_at)))::DOUBLE / 60, 0)"
    parts = [
        share("amount", 10000),
        share("installments", 12),
        f"CASE WHEN avg_amount = 0 THEN 1.0 ELSE {share('amount / avg_amount', 10)} END",
        "round_even(coalesce(hour(requested_at), 0) / 23::DOUBLE * 10000, 0) / 10000",
        "round_even(coalesce(isodow(requested_at) - 1, 2) / 6::DOUBLE * 10000, 0) / 10000",
        f"CASE WHEN {last_missing} THEN -1.0 ELSE {share(minutes, 1440)} END",
        f"CASE WHEN {last_missing} THEN -1.0 ELSE {share('last_km', 1000)} END",
        share("km_from_home", 1000),
        share("tx_count_24h", 20),
        "CAST(is_online AS INT)",
        "CAST(card_present AS INT)",
        "1 - CAST(coalesce(list_contains(known_merchants, merchant_id), FALSE) AS INT)",
        RISK_OF,
        share("merchant_avg", 10000),
    ]
    return [f"{as_float(p)} AS f{i}" for i, p in enumerate(parts)]


EVENTS = """e AS (SELECT *, abs(coalesce(value, 0)) AS amount FROM events),
users AS (SELECT user_id, round(avg(amount), 6) AS avg_amount, coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0)), []) AS known_merchants FROM e GROUP BY user_id),
kinds AS (SELECT event_type, round(avg(amount), 6) AS merchant_avg FROM e GROUP BY event_type),
req AS (SELECT event_id, CAST(event_id % 7 = 0 AS INT) AS fraud, amount, event_id % 12 + 1 AS installments, ts AS requested_at, avg_amount,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS tx_count_24h, known_merchants, event_type AS merchant_id,
  CASE event_type WHEN 'signup' THEN '5411' WHEN 'view' THEN '5812' WHEN 'purchase' THEN '7995' WHEN 'error' THEN '7801' END AS mcc, merchant_avg,
  event_id % 2 = 0 AS is_online, event_id % 3 = 0 AS card_present, (event_id % 500)::DOUBLE AS km_from_home,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_at, (event_id % 97) * 1.5::DOUBLE AS last_km
  FROM e JOIN users USING (user_id) JOIN kinds USING (event_type))"""
EVENT_FEATURES = f"ft AS (SELECT event_id, fraud, {', '.join(features())} FROM req)"


def q(i: int) -> str:
    return f"greatest(least(round_even(f{i} * 4096, 0), 32767), -32768)::BIGINT"


def bucket(i: int, n: int) -> str:
    return f"CASE WHEN {q(i)} <= 0 THEN 0 ELSE least({n - 1}, {q(i)} * {n} // 4097) END"


KEY = " | ".join(
    f"(({expr})::BIGINT << {shift})"
    for expr, shift in (
        (bucket(2, 16), 0),
        (bucket(7, 8), 4),
        (bucket(8, 4), 7),
        (bucket(12, 4), 9),
        (bucket(0, 4), 11),
        (f"CAST({q(5)} < 0 AS INT)", 13),
        (f"CAST({q(9)} > 0 AS INT)", 14),
        (f"CAST({q(10)} > 0 AS INT)", 15),
        (f"CAST({q(11)} > 0 AS INT)", 16),
        (bucket(6, 4), 17),
        (f"CAST({q(1)} > 410 AS INT)", 19),
        (bucket(13, 4), 20),
    )
)
KEYS = f"keyed AS (SELECT event_id AS ref_id, fraud, CAST({KEY} AS INT) AS pkey FROM ft)"


def table(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT pkey, bit_or(CASE WHEN fraud = 1 THEN 2 ELSE 1 END) AS mask, CAST(least(count(*), 65535) AS INT) AS cnt FROM keyed WHERE {where} GROUP BY pkey)"


PROFILE = (EVENTS, EVENT_FEATURES, KEYS)
FEATURE_NAMES = ", ".join(f"f{i}" for i in range(14))

_ORDERS = f"""per_order AS (SELECT l_orderkey AS o_orderkey, count(*) AS installments, min(l_suppkey) AS supplier, round(avg(l_extendedprice), 2) AS merchant_avg FROM lineitem GROUP BY l_orderkey),
cust AS (SELECT o_custkey, round(avg(o_totalprice), 4) AS avg_amount, count(*) AS tx_count_24h FROM orders GROUP BY o_custkey),
req AS (SELECT o.o_orderkey, o_totalprice AS amount, installments, o_orderdate AS requested_at, avg_amount, tx_count_24h,
  ['m-1', 'm-2', 'm-' || (o.o_custkey % 10)] AS known_merchants, 'm-' || (supplier % 10) AS merchant_id,
  CASE WHEN supplier % 2 = 0 THEN '5411' WHEN supplier % 5 = 0 THEN '9999' ELSE '7995' END AS mcc, merchant_avg,
  o_orderstatus = 'O' AS is_online, o_orderstatus = 'F' AS card_present, (c_nationkey * 40)::DOUBLE AS km_from_home,
  lag(o_orderdate) OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o.o_orderkey) AS last_at, (supplier % 700)::DOUBLE AS last_km
  FROM orders o JOIN per_order USING (o_orderkey) JOIN cust ON cust.o_custkey = o.o_custkey JOIN customer ON c_custkey = o.o_custkey)"""


#: Requests of the events' changed documents: ``req`` is what is read of them, with ``ok``.
_ODD = """odd AS (SELECT * REPLACE (
  CASE c WHEN 3 THEN 0 ELSE amount END AS amount, CASE c WHEN 5 THEN NULL ELSE requested_at END AS requested_at, CASE c WHEN 7 THEN 0 ELSE avg_amount END AS avg_amount,
  CASE c WHEN 0 THEN NULL WHEN 2 THEN '12' || mcc ELSE mcc END AS mcc, is_online AND c NOT IN (6, 8) AS is_online, card_present AND c <> 6 AS card_present,
  CASE c WHEN 6 THEN 0 ELSE km_from_home END AS km_from_home), last_at IS NOT NULL AS has_last, c NOT IN (4, 9) AND NOT (c = 5 AND last_at IS NOT NULL) AS ok FROM (SELECT *, event_id % 11 AS c FROM req))"""
_ODD_FEATURES = f"oft AS (SELECT event_id, fraud, c, ok, {', '.join(features('NOT has_last'))} FROM odd)"
_ODD_NAME = "CASE c " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _, _) in enumerate(views.ODD)) + " ELSE 'plain' END"
_GOLDEN = """req AS (SELECT o_orderkey, o_totalprice AS amount, o_orderkey % 24 AS installments, date_trunc('day', o_orderdate) + INTERVAL '21:07:45' AS requested_at, 64000.5::DOUBLE AS avg_amount, 4 AS tx_count_24h,
  ['m-7', 'm-9'] AS known_merchants, 'm-9' AS merchant_id, '5944' AS mcc, 812.25::DOUBLE AS merchant_avg, FALSE AS is_online, TRUE AS card_present, 37.5::DOUBLE AS km_from_home,
  date_trunc('day', o_orderdate) + INTERVAL '19:52:30' AS last_at, 12.75::DOUBLE AS last_km FROM orders)"""
_AT, _LAST = "TIMESTAMP '2026-04-15 13:42:11'", "TIMESTAMP '2026-04-15 11:10:00'"


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values) + "]"


_GRID = f"""grid AS (SELECT o_orderkey, i, {_list(generate.AMOUNTS)}[i // 50 + 1] AS a, {_list(generate.KMS)}[i % 5 + 1] AS km, {_list(generate.CATEGORIES)}[i // 5 % 10 + 1] AS mcc FROM (SELECT o_orderkey, o_orderkey % 500 AS i FROM orders)),
req AS (SELECT o_orderkey, i, round(a, 2) AS amount, {_list(generate.INSTALLMENTS)}[i % 4 + 1] AS installments, {_AT} AS requested_at, round(a / 1.5, 2) AS avg_amount, {_list(generate.COUNTS)}[i % 5 + 1] AS tx_count_24h,
  [{', '.join(_list(names) for names in generate.KNOWN)}][i % 4 + 1] AS known_merchants, '{generate.MERCHANT}' AS merchant_id, mcc, round(a * 0.9, 2) AS merchant_avg,
  {_list(tuple(a for a, _ in generate.FLAGS))}[i % 4 + 1] AS is_online, {_list(tuple(b for _, b in generate.FLAGS))}[i % 4 + 1] AS card_present, km AS km_from_home, {_LAST} AS last_at, round(km / 2, 2) AS last_km FROM grid)"""

_PASS1 = (scanned("p1", f"probe <= {NPROBE}"), top("t1", "p1", 5), voted("v1", "t1"), pairs("fp", "fix", "q"), top("t2", "fp", 5), voted("v2", "t2"))
_FIRST6 = (scanned("p1", f"probe <= {NPROBE}"), top("f6", "p1", 6))
_SURVIVORS = (
    *STEP,
    *CLUSTERS,
    *PROBES,
    *_FIRST6,
    "worst AS (SELECT qid, CASE WHEN count(*) >= 6 THEN max(d) END AS worst FROM f6 GROUP BY qid)",
    f"""left_over AS (SELECT qid, count(*) AS unprobed, count(*) FILTER (WHERE worst IS NULL OR (dc <= (radius + ceil(sqrt(worst))) * (radius + ceil(sqrt(worst))) AND {BOUND} <= worst)) AS survivors
FROM probes JOIN boxes USING (cluster_id) JOIN rad USING (cluster_id) LEFT JOIN worst USING (qid) WHERE probe > {NPROBE} GROUP BY qid)""",
)

_LOWER = "greatest(triangle, box)"


def _later_rounds() -> list[str]:
    """Each later round visits twice as many clusters, under the worst distance of the rounds before."""
    parts, kept = [], ["SELECT cnt, 1 AS round, TRUE AS kept, FALSE AS far FROM turns WHERE turn < 2"]
    done, step, best, worst = NPROBE, 2 * NPROBE, "f6", "worst"
    for n in (2, 3, 4):
        parts += [
            f"r{n} AS (SELECT turns.*, worst, coalesce({_LOWER} <= worst, TRUE) AS kept FROM turns LEFT JOIN {worst} USING (qid) WHERE turn BETWEEN {done} AND {done + step - 1})",
            f"c{n} AS (SELECT qid, ref_id, fraud, d FROM {best} UNION ALL SELECT s.qid, m.ref_id, m.fraud, {dist('s.qv', 'm.q')} AS d FROM r{n} s JOIN mem m USING (cluster_id) WHERE kept AND s.qid <> m.ref_id)",
            top(f"b{n}", f"c{n}", 6),
            f"w{n} AS (SELECT qid, CASE WHEN count(*) >= 6 THEN max(d) END AS worst FROM b{n} GROUP BY qid)",
        ]
        kept.append(f"SELECT cnt, {n}, kept, triangle > worst FROM r{n}")
        done, step, best, worst = done + step, 2 * step, f"b{n}", f"w{n}"
    return [*parts, f"every AS ({' UNION ALL '.join(kept)})"]


_ROUNDS = (
    *_SURVIVORS[:-1],
    f"""gaps AS (SELECT qid, qv, cluster_id, probe, cnt, ceil(sqrt(dc)) - radius AS gap, {BOUND} AS box FROM probes JOIN boxes USING (cluster_id) JOIN rad USING (cluster_id)),
lower AS (SELECT *, CASE WHEN gap >= 1 THEN (gap - 1) * (gap - 1) + 1 ELSE 0 END AS triangle FROM gaps),
turns AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY probe > {NPROBE}, CASE WHEN probe > {NPROBE} THEN gap ELSE 0 END, cluster_id) - 1 AS turn FROM lower)""",
    *_later_rounds(),
)

SQL: dict[str, str] = {
    "exact_knn_vote": with_(*EXACT) + verdict("ev"),
    "exact_knn_neighbors": with_(*EXACT) + "SELECT qid, rk, ref_id, fraud, round(d, 9) AS d FROM en",
    "exact_knn_kernel": with_(*EXACT) + "SELECT qid, rk, ref_id, fraud, round(d, 9) AS d FROM en",
    "quantize_vectors": with_(EMB, FIX) + "SELECT ref_id, array_to_string(list_transform(q, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS q, fraud FROM fix",
    "int16_knn_topk": with_(*SIX) + "SELECT qid, rk, ref_id, fraud, CAST(d AS BIGINT) AS d FROM six",
    "knn_rerank_5of6": with_(*SIX, *RERANKED) + verdict("rv"),
    "rerank_skip_split": with_(*SIX, *RERANKED, *DECIDED) + "SELECT path, count(*) AS n, count(*) FILTER (WHERE fraud_count >= 3) AS denied FROM decided GROUP BY path",
    "knn_agreement": with_(*EXACT, FIX, pairs("fp", "fix", "q"), top("f5", "fp", 5), voted("fv", "f5"))
    + """SELECT count(*) AS n, count(*) FILTER (WHERE (a.fraud_count < 3) = (b.fraud_count < 3)) AS agree, count(*) FILTER (WHERE (a.fraud_count < 3) <> (b.fraud_count < 3)) AS disagree,
count(*) FILTER (WHERE a.fraud_count < 3 AND b.fraud_count >= 3) AS false_positives, count(*) FILTER (WHERE a.fraud_count >= 3 AND b.fraud_count < 3) AS false_negatives,
count(*) FILTER (WHERE a.fraud_count <> b.fraud_count) AS count_mismatches, round(count(*) FILTER (WHERE (a.fraud_count < 3) = (b.fraud_count < 3)) * 100.0::DOUBLE / count(*), 4) AS agree_pct FROM ev a JOIN fv b USING (qid)""",
    "knn_disagreements": with_(*EXACT, voted("three", "en", 3)) + "SELECT qid, a.fraud_count AS oracle_count, b.fraud_count AS candidate_count FROM ev a JOIN three b USING (qid) WHERE (a.fraud_count < 3) <> (b.fraud_count < 2) ORDER BY qid LIMIT 50",
    "kmeans_seeds": with_(*STEP) + "SELECT cluster_id, ref_id FROM seed",
    "kmeans_assign_once": with_(*STEP) + "SELECT ref_id, cluster_id, round(d, 9) AS d FROM asg",
    "kmeans_recompute_once": with_(*STEP) + f"SELECT CAST(c AS INT) AS cluster_id, count(ref_id) AS cnt, CAST(i - 1 AS INT) AS dim, round(coalesce(avg(vec[i]), 0), 9) AS mean FROM range({K}) r(c) LEFT JOIN asg ON asg.cluster_id = c, range(1, 65) s(i) GROUP BY c, i",
    "kmeans_seeded_argmin": with_(*STEP) + "SELECT cluster_id, count(*) AS cnt, round(sum(d), 6) AS inertia FROM asg GROUP BY cluster_id",
    "kmeans_two_rounds": with_(*STEP, *lloyd(1, "asg"), *lloyd(2, "asg1"))
    + "SELECT cluster_id, cnt, CAST(i - 1 AS INT) AS dim, round(centroid[i], 6) AS mean FROM cen2 JOIN (SELECT c.cluster_id, count(ref_id) AS cnt FROM cen2 c LEFT JOIN asg2 USING (cluster_id) GROUP BY 1) USING (cluster_id), range(1, 65) r(i)",
    "cluster_bbox": with_(*STEP, *CLUSTERS) + "SELECT cluster_id, CAST(dim AS INT) AS dim, CAST(low AS INT) AS low, CAST(high AS INT) AS high FROM box",
    "cluster_radius": with_(*STEP, *CLUSTERS) + "SELECT cluster_id, cnt, radius FROM rad",
    "cluster_offsets": with_(*STEP) + f"SELECT cluster_id, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT CAST(c AS INT) AS cluster_id, count(ref_id) AS cnt FROM range({K}) r(c) LEFT JOIN asg ON asg.cluster_id = c GROUP BY c)",
    "cluster_slots": with_(*STEP) + "SELECT ref_id, cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY d, ref_id) - 1 AS INT) AS slot FROM asg",
    "bbox_lower_bound": with_(*STEP, *CLUSTERS, *PROBES) + f"SELECT qid, cluster_id, CAST({BOUND} AS BIGINT) AS lb, CAST(dc AS BIGINT) AS dc FROM probes JOIN boxes USING (cluster_id)",
    "partial_distances": with_(EMB, FIX) + "SELECT a.ref_id AS qid, b.ref_id, CAST(list_sum(list_transform(range(1, 9), lambda i: (a.q[i] - b.q[i]) * (a.q[i] - b.q[i]))) AS BIGINT) AS head, CAST(list_sum(list_transform(range(57, 65), lambda i: (a.q[i] - b.q[i]) * (a.q[i] - b.q[i]))) AS BIGINT) AS tail FROM fix a JOIN fix b ON a.ref_id <> b.ref_id WHERE a.ref_id % 100 = 0",
    "probe_clusters": with_(*STEP, *CLUSTERS, *PROBES) + f"SELECT qid, cluster_id, probe FROM probes WHERE probe <= {NPROBE}",
    "unprobed_anti": with_(*STEP, *CLUSTERS, *PROBES) + f"SELECT qid, cluster_id FROM probes WHERE probe > {NPROBE}",
    "triangle_prune": with_(*_SURVIVORS) + "SELECT * FROM left_over",
    "search_counters": with_(*_SURVIVORS) + f"SELECT {NPROBE} * count(*) AS probed, CAST(sum(survivors) AS BIGINT) AS repaired, CAST(sum(unprobed - survivors) AS BIGINT) AS pruned FROM left_over",
    "ivf_search": with_(*SIX) + "SELECT qid, rk, ref_id, CAST(d AS BIGINT) AS d FROM six",
    "ivf_routed": with_(*SIX) + "SELECT qid, rk, ref_id, CAST(d AS BIGINT) AS d FROM six",
    "index_score": with_(*SIX, *RERANKED, *DECIDED) + verdict("decided", "path"),
    "repair_rounds": with_(*_ROUNDS)
    + "SELECT count(*) FILTER (WHERE round = 1) AS probed, count(*) FILTER (WHERE round > 1 AND kept) AS repaired, count(*) FILTER (WHERE NOT kept AND far) AS by_triangle, count(*) FILTER (WHERE NOT kept AND NOT far) AS by_box, CAST(sum(cnt) FILTER (WHERE kept) AS BIGINT) AS measured FROM every",
    "ivf_score": with_(*SIX, *RERANKED, *DECIDED) + verdict("decided", "path"),
    "ivf_unrepaired": with_(*STEP, *CLUSTERS, *PROBES, *_FIRST6) + "SELECT qid, rk, ref_id, CAST(d AS BIGINT) AS d FROM f6",
    "ivf_repair_equals_brute": with_(*SIX) + "SELECT CAST(p AS INT) AS nprobe, count(*) AS n, CAST(0 AS BIGINT) AS different FROM six, (VALUES (1), (2), (8)) v(p) GROUP BY p",
    "kmknn_search": with_(*STEP, *CLUSTERS, *PROBES, *_PASS1) + verdict("(SELECT qid, CASE WHEN v1.fraud_count BETWEEN 2 AND 4 THEN v2.fraud_count ELSE v1.fraud_count END AS fraud_count, CASE WHEN v1.fraud_count BETWEEN 2 AND 4 THEN 'pass2' ELSE 'pass1' END AS path FROM v1 JOIN v2 USING (qid))", "path"),
    "features_from_events": with_(EVENTS, EVENT_FEATURES) + f"SELECT event_id, {FEATURE_NAMES} FROM ft",
    "features_from_orders": with_(_ORDERS) + f"SELECT o_orderkey, {', '.join(features())} FROM req",
    "profile_keys": with_(*PROFILE) + "SELECT ref_id, pkey FROM keyed",
    "profile_table": with_(*PROFILE, table("tab")) + "SELECT * FROM tab",
    "profile_census": with_(*PROFILE, table("tab")) + "SELECT count(*) FILTER (WHERE mask = 1) AS pure_legit, count(*) FILTER (WHERE mask = 2) AS pure_fraud, count(*) FILTER (WHERE mask = 3) AS mixed, 4194304 - count(*) AS empty FROM tab",
    "profile_score": with_(*PROFILE, table("tab", "ref_id % 50 <> 0"))
    + f"SELECT ref_id, pkey, fraud_count, fraud_count < 3 AS approved FROM (SELECT k.ref_id, k.pkey, CASE WHEN cnt >= {MIN_COUNT} AND mask = 1 THEN 0 WHEN cnt >= {MIN_COUNT} AND mask = 2 THEN 5 END AS fraud_count FROM keyed k LEFT JOIN tab USING (pkey) WHERE ref_id % 50 = 0)",
    "unanimity_skip_counts": with_(*STEP, *CLUSTERS, *PROBES, *_FIRST6)
    + "SELECT count(*) AS n, count(*) FILTER (WHERE found = 6 AND frauds IN (0, 6)) AS unanimous, count(*) FILTER (WHERE found = 6 AND (frauds <= 1 OR frauds >= 5)) AS deterministic FROM (SELECT qid, sum(fraud) AS frauds, count(*) AS found FROM f6 GROUP BY qid)",
    "threshold_sweep": with_(
        *PROFILE,
        table("tab", "ref_id % 50 <> 0"),
        f"vec AS (SELECT event_id AS ref_id, fraud, {', '.join(f'{q(i)} AS q{i}' for i in range(14))} FROM ft)",
        f"near AS (SELECT a.ref_id, b.fraud, row_number() OVER (PARTITION BY a.ref_id ORDER BY {' + '.join(f'(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})' for i in range(14))}, b.ref_id) AS rk FROM vec a, vec b WHERE a.ref_id % 50 = 0 AND b.ref_id % 50 <> 0)",
        "voted AS (SELECT ref_id, sum(fraud) < 3 AS approved FROM near WHERE rk <= 5 GROUP BY ref_id)",
        "tested AS (SELECT mask, cnt, approved, fraud = 0 AS expected FROM keyed JOIN voted USING (ref_id) LEFT JOIN tab USING (pkey) WHERE ref_id % 50 = 0)",
        f"swept AS (SELECT min_count, coalesce(cnt >= min_count AND mask IN (1, 2), FALSE) AS fast, CASE WHEN coalesce(cnt >= min_count AND mask IN (1, 2), FALSE) THEN mask = 1 ELSE approved END AS final, expected FROM tested, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) v(min_count))",
    )
    + "SELECT min_count, count(*) AS n, count(*) FILTER (WHERE fast) AS covered, count(*) FILTER (WHERE final = expected) AS correct, count(*) FILTER (WHERE expected AND NOT final) AS false_positives, count(*) FILTER (WHERE NOT expected AND final) AS false_negatives FROM swept GROUP BY min_count",
    "path_counters": with_(
        *PROFILE,
        table("tab", "ref_id % 50 <> 0"),
        f"vec AS (SELECT event_id AS ref_id, fraud, {FEATURE_NAMES}, {', '.join(f'{q(i)} AS q{i}' for i in range(14))} FROM ft)",
        f"shortcut AS (SELECT ref_id, CASE WHEN cnt >= {MIN_COUNT} AND mask = 1 THEN 0 WHEN cnt >= {MIN_COUNT} AND mask = 2 THEN 5 END AS fraud_count FROM keyed LEFT JOIN tab USING (pkey) WHERE ref_id % 50 = 0)",
        f"near AS (SELECT a.ref_id AS qid, b.ref_id, b.fraud, {' + '.join(f'(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})' for i in range(14))} AS d, {' + '.join(f'(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})' for i in range(14))} AS e FROM vec a JOIN shortcut s ON s.ref_id = a.ref_id AND s.fraud_count IS NULL, vec b WHERE b.ref_id % 50 <> 0)",
        top("six", "near", 6),
        "rd AS (SELECT qid, ref_id, fraud, e AS d FROM six)",
        top("rr", "rd", 5),
        voted("rv", "rr"),
        *DECIDED,
        "every AS (SELECT fraud_count, path FROM decided UNION ALL SELECT fraud_count, 'profile' FROM shortcut WHERE fraud_count IS NOT NULL)",
    )
    + "SELECT path, count(*) AS n, count(*) FILTER (WHERE fraud_count >= 3) AS denied FROM every GROUP BY path",
    "features_golden": with_(_GOLDEN) + f"SELECT o_orderkey, TRUE AS parse_ok, {', '.join(features())} FROM req",
    "payload_edge_cases": with_(EVENTS, _ODD, _ODD_FEATURES) + f"SELECT event_id, {_ODD_NAME} AS \"case\", ok AS parse_ok, {', '.join(f'CASE WHEN ok THEN f{i} END AS f{i}' for i in range(14))} FROM oft",
    "warm_up_counts": with_(EVENTS, _ODD) + "SELECT count(*) FILTER (WHERE ok) AS scored, count(*) FILTER (WHERE NOT ok) AS skipped, greatest(0, 20000 - count(*) FILTER (WHERE ok)) AS drawn FROM odd",
    "stream_score": with_(
        EVENTS,
        EVENT_FEATURES,
        _ODD,
        _ODD_FEATURES,
        f"near AS (SELECT a.event_id AS qid, b.event_id AS ref_id, b.fraud, {' + '.join(f'(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})' for i in range(14))} AS d FROM oft a, ft b WHERE a.ok AND a.event_id % 50 = 0)",
        top("five", "near", 5),
        voted("v", "five"),
        "s AS (SELECT event_id AS qid, ok AS parse_ok, coalesce(v.fraud_count, 0) AS fraud_count FROM oft LEFT JOIN v ON v.qid = event_id WHERE event_id % 50 = 0)",
    )
    + """SELECT qid, parse_ok, CASE WHEN parse_ok THEN 'exact' ELSE 'fallback' END AS path, CAST(fraud_count AS INT) AS fraud_count, fraud_count < 3 AS approved, '{"approved":' || (fraud_count < 3) || ',"fraud_score":' || round(fraud_count * 0.2::DOUBLE, 1) || '}' AS response FROM s""",
    "features_from_payloads": with_(EVENTS, EVENT_FEATURES) + f"SELECT event_id, TRUE AS parse_ok, {FEATURE_NAMES} FROM ft",
    "stream_append": with_(
        EVENTS,
        EVENT_FEATURES,
        f"near AS (SELECT a.event_id AS qid, b.event_id AS ref_id, b.fraud, {' + '.join(f'(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})' for i in range(14))} AS d FROM ft a, ft b WHERE a.event_id % 50 = 0 AND b.event_id % 50 <> 0)",
        top("five", "near", 5),
        voted("v", "five"),
    )
    + """SELECT qid, TRUE AS parse_ok, 'exact' AS path, fraud_count, fraud_count < 3 AS approved, '{"approved":' || (fraud_count < 3) || ',"fraud_score":' || round(fraud_count * 0.2::DOUBLE, 1) || '}' AS response FROM v""",
    "json_props_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.missing') AS INT) AS missing FROM events",
    "merchant_semi_join": with_(EVENTS) + "SELECT event_id, merchant_id FROM req WHERE list_contains(known_merchants, merchant_id)",
    "mcc_left_join": with_(EVENTS) + f"SELECT event_id, CAST({RISK_OF} AS DOUBLE) AS risk FROM req",
    "payload_grid": with_(_GRID) + f"SELECT o_orderkey, i, TRUE AS parse_ok, {', '.join(features())} FROM req",
    "latency_percentiles": "SELECT n, round(mean, 6) AS mean, " + ", ".join(f"s[CAST(floor(n * {p}) AS INT) + 1] AS p{int(round(p * 100))}" for p in (0.5, 0.9, 0.95, 0.99)) + ", mx AS max FROM (SELECT count(value) AS n, avg(value) AS mean, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS s, max(value) AS mx FROM events)",
    "response_json": with_(*EXACT) + """SELECT qid, '{"approved":' || (fraud_count < 3) || ',"fraud_score":' || round(fraud_count * 0.2::DOUBLE, 1) || '}' AS response FROM ev""",
}
