"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from nearvote.llm.licenses import CLAIM, DIGESTS, KNOWN, NOTICES, RESERVED, SPELLINGS, TERMS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x20\x09-\x0D]+')".format(_UPPER, _LOWER)

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS x, u AS y FROM both_ways UNION SELECT r.x, b.v FROM reach r JOIN both_ways b ON b.u = r.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM sets LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = doc_id"""

_CELL = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 3)"

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS l, count(*) AS c FROM w GROUP BY n_tokens),
p AS (SELECT l, sum(c) OVER (ORDER BY l)::BIGINT AS r, sum(c * l) OVER (ORDER BY l)::BIGINT AS t FROM h),
a AS (SELECT list(l ORDER BY l) AS ls, list_prepend(0::BIGINT, list(r ORDER BY l)) AS rs, list_prepend(0::BIGINT, list(t ORDER BY l)) AS ts, count(*)::BIGINT AS d FROM p),
dp AS (SELECT 1 AS layer, list_transform(range(0, d + 1), lambda j: CASE WHEN j = 0 THEN 0::BIGINT ELSE ls[j] * rs[j + 1] - ts[j + 1] END) AS cost, CAST([] AS BIGINT[][]) AS cuts FROM a
  UNION ALL
  SELECT layer + 1, list_transform(best, lambda b: b[1]), list_append(cuts, list_transform(best, lambda b: b[2])) FROM (
    SELECT dp.layer, dp.cuts, list_transform(range(0, d + 1), lambda j: CASE WHEN j <= dp.layer THEN [4000000000000000000, 0]
      ELSE list_min(list_transform(range(dp.layer, j), lambda i: [cost[i + 1] + ls[j] * (rs[j + 1] - rs[i + 1]) - (ts[j + 1] - ts[i + 1]), i])) END) AS best
    FROM dp, a WHERE dp.layer < least(8, d))),
last_layer AS (SELECT cuts, layer FROM dp ORDER BY layer DESC LIMIT 1),
back AS (SELECT layer, d AS j, cuts FROM last_layer, a UNION ALL SELECT layer - 1, cuts[layer - 1][j + 1], cuts FROM back WHERE layer > 1),
bounds AS (SELECT CAST(layer - 1 AS INT) AS bucket, ls[j] AS upper FROM back, a),
placed AS (SELECT doc_id, n_tokens, min_by(bucket, upper) AS bucket, min(upper) AS bucket_length FROM w JOIN bounds ON upper >= n_tokens GROUP BY doc_id, n_tokens),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_CELL}, doc_id) - 1 AS place, greatest(1, 16384 // greatest(bucket_length, 1)) AS each FROM placed)
SELECT doc_id, n_tokens, bucket, bucket_length, CAST(place // each AS BIGINT) AS batch, CAST(place % each AS BIGINT) AS slot, bucket_length - n_tokens AS padding FROM numbered"""

_TWO64, _TWO31 = 2**64, 2**31
# CRC-32: the table comes from its polynomial, eight steps for each byte value.
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"

OP5 = f"""WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, {_CRC_STEP}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
  lambda s, x: xor(s // 256, tab[xor(s, x) % 256 + 1])), 4294967295) AS text_crc32 FROM raw, crc),
jumps AS (SELECT doc_id, shards, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + {_TWO64} ELSE doc_id::HUGEINT END AS key, 0::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (8), (9)) v(shards)
  UNION ALL
  SELECT doc_id, shards, nk, j, CAST(floor((j + 1) * ({_TWO31}::DOUBLE / (CAST(nk // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM (
    SELECT doc_id, shards, j, CAST((CAST(key AS UHUGEINT) * 2862933555777941757 + 1) % {_TWO64} AS HUGEINT) AS nk FROM jumps WHERE j < shards)),
ends AS (SELECT doc_id, shards, CAST(max(b) AS INT) AS shard FROM jumps WHERE j >= shards GROUP BY doc_id, shards)
SELECT s.doc_id, size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 3), s.doc_id) - 1 AS slot, b.shard AS grown_shard
FROM sums s JOIN ends a ON a.doc_id = s.doc_id AND a.shards = 8 JOIN ends b ON b.doc_id = s.doc_id AND b.shards = 9"""


def _canonical(x: str) -> str:
    form = f"regexp_replace({x}, '{TERMS}', 'copyright\\1', 'g')"
    form = f"lower(regexp_replace({form}, '{CLAIM}', '\\1', 'g'))"
    form = f"regexp_replace({form}, '{RESERVED}', '\\1', 'g')"
    for pattern, common in SPELLINGS:
        form = f"regexp_replace({form}, '{pattern}', '{common}', 'g')"
    return rf"trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: tuple[tuple[str, str], ...]) -> str:
    return "VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows)


OP6 = f"""WITH known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_canonical('body')}) AS digest, license FROM ({_values(KNOWN)}) v(license, body)
  UNION ALL SELECT digest, license FROM ({_values(DIGESTS)}) v(license, digest)) GROUP BY 1),
notices AS (SELECT sha256({_canonical('body')}) AS digest, license FROM ({_values(NOTICES)}) v(license, body)),
rows AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT doc_id, {_canonical('line')} AS c FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM rows)),
hits AS (SELECT doc_id, license FROM lines JOIN notices ON digest = sha256(c) WHERE length(c) >= 8),
named AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM hits GROUP BY doc_id)
SELECT r.doc_id, r.digest, known.license, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, coalesce(names, '') AS line_licenses
FROM (SELECT doc_id, sha256({_canonical('body')}) AS digest FROM rows) r LEFT JOIN known USING (digest) LEFT JOIN named ON named.doc_id = r.doc_id"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)

OP11 = f"""WITH t AS (SELECT doc_id, len({_TERMS}) AS n, {_TERMS} AS ts FROM documents),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM t WHERE n > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY term, docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS impact FROM tf JOIN w USING (term), size),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores QUALIFY rank <= 10"""

_WHOLE = """SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q, {} FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_DOT = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT)"

OP12 = f"""WITH v AS ({_WHOLE.format("1 AS one")}),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DOT} AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs QUALIFY rank <= 5"""

OP13 = f"""WITH v AS ({_WHOLE.format("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, {_DOT} AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

SQL = {"op1_ngram_jaccard_join": OP1, "op3_packing": OP3, "op5_sharding": OP5, "op6_license_scans": OP6, "op11_ranked_search": OP11, "op12_exact_topk": OP12, "op13_hard_negatives": OP13}
