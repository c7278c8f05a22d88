"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

Every expression is a built-in one. Patterns find assigned, access-key and long
hexadecimal secrets. Any other long token is a candidate: its encoding is inferred from
its characters, and against that alphabet it meets three tests.

* Chi-squared uniformity. Its statistic is also the discovery test: the null
  hypothesis is natural text, whose symbols repeat more often than random ones, so under
  the null the statistic is non-central and grows with the length. The lower tail
  gives the p-value; a long token gets a small one only if it really looks uniform.
* Runs above and below the middle of the alphabet, and lag-1 serial correlation. These
  two and unevenness gate: each must be consistent with randomness at a fixed level, which
  words and counters fail. A token that fails one enters the discovery control with p = 1.

Candidates that pass are put to false-discovery control (Benjamini-Hochberg) within
strata of length, so the many short tokens do not set the threshold of the long ones.
P-values are rounded up to a grid, so the procedure needs only counts per grid cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from nearvote.llm import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# With {n,} these find what the plain runs find whose length is n or more.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (pattern of the whole token, its alphabet, chance that two symbols of natural text agree)
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef", 0.10),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.10),
    ("^[a-z]+$", _LOWER, 0.066),
    ("^[A-Z]+$", _UPPER, 0.066),
    ("^[A-Z2-7]+$", _UPPER + "234567", 0.066),
    ("^[a-z0-9]+$", _LOWER + _DIGITS, 0.066),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.066),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.066),
    ("^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/", 0.066),
)


@dataclass(frozen=True)
class SecretConfig:
    """``shortest`` candidate; least p of the randomness tests; false-discovery rate; strata."""

    shortest: int = 20
    consistent: float = 0.001
    rate: float = 0.01
    strata: tuple[int, ...] = (32, 64, 128)
    grid: int = 50


#: Values that one fold runs over; each fold copies what it has gathered so far.
FOLD = 128
#: Code points of a block of text are 1 << this.
BLOCK_BITS = 10
#: Stands for a character of a span that is already found.
COVER = "\x01"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge) -> Column:
    """What ``merge`` makes of the values before each one, from 0, for array<int> ``values``.

    Folds of FOLD values and one fold over their results: linear for any length that texts have.
    """

    def fold(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(merge(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        wholes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), merge))
        return F.flatten(F.zip_with(parts, fold(wholes, F.lit(0)), fold))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda i: F.slice(all_, i * FOLD + 1, F.lit(FOLD)))

    return _bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(_bound(cut(v), joined)))


def _find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of the leftmost non-overlapping matches, in code points."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,token:string>>)")

    def placed(x: Column) -> Column:
        gaps = F.transform(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), lambda p: F.length(p))
        return _bound(gaps, lambda g: F.zip_with(F.zip_with(_running(F.zip_with(g, x["found"], lambda n, t: n + F.length(t)), lambda at, v: at + v), g, lambda at, n: at + n), x["found"], lambda at, t: F.struct(at.alias("start"), (at + F.length(t)).alias("end"), t.alias("token"))))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), _bound(both, placed)).otherwise(empty)


def _replaced(text: Column, spans: Column, cover) -> Column:
    """``text`` with ``cover(span, at)`` in place of every span, where ``at`` is the end of the
    spans before it, which may lie beyond the span's start. Spans are sorted by start."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        # Only the blocks that hold the piece are walked through.
        first = F.shiftright(a, BLOCK_BITS)
        near = F.array_join(F.slice(blocks, first + 1, F.shiftright(b - 1, BLOCK_BITS) - first + 1), "")
        return F.when(b > a, F.substr(near, a % (1 << BLOCK_BITS) + 1, b - a)).otherwise("")

    def whole(x: Column) -> Column:
        parts = F.zip_with(x["spans"], x["at"], lambda s, at: F.concat(piece(x["blocks"], at, F.greatest(at, s["start"])), cover(s, at)))
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.array_join(F.concat(parts, F.array(piece(x["blocks"], last, x["n"]))), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))
    ends = _running(F.transform(spans, lambda s: s["end"]), lambda at, v: F.greatest(at, v))
    return F.when(F.size(spans) > 0, _bound(F.struct(blocks.alias("blocks"), spans.alias("spans"), ends.alias("at"), F.length(text).alias("n")), whole)).otherwise(text)


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) by the continued fraction of the tail, from both sides of 0."""
    a = F.abs(z)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.least(F.lit(0.5), F.exp(-a * a / 2) / (fraction * 2.5066282746310002))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(token: Column) -> Column:
    """struct(natural, consistent): p under natural text, least p of runs and correlation."""
    body = F.rtrim(F.translate(token, "=", " "))
    n = F.length(body).cast("double")
    alphabet = F.coalesce(*(F.when(body.rlike(p), F.lit(a)) for p, a, _ in ENCODINGS), F.lit(ENCODINGS[-1][1]))
    chance = F.coalesce(*(F.when(body.rlike(p), F.lit(c)) for p, _, c in ENCODINGS), F.lit(ENCODINGS[-1][2]))
    plain = F.when(alphabet == ENCODINGS[-1][1], F.translate(body, "-_", "+/")).otherwise(body)
    base = F.struct(plain.alias("s"), n.alias("n"), alphabet.alias("a"), F.length(alphabet).cast("double").alias("k"), chance.alias("c"))

    def chars(s: Column) -> Column:
        return F.filter(F.split(s, "", -1), lambda c: c != "")

    def codes(x: Column) -> Column:
        # A capital and its small letter stay apart: positions are looked up by case.
        return F.transform(chars(x["s"]), lambda c: F.position(c, x["a"]).cast("double") - 1)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def tests(x: Column) -> Column:
        squares = total(F.transform(chars(x["a"]), lambda c: F.pow(x["n"] - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2.0))))
        chi = squares * x["k"] / x["n"] - x["n"]
        shift = (x["n"] - 1) * (x["k"] * x["c"] - 1)
        natural = _upper_tail(-(chi - (x["k"] - 1) - shift) / F.sqrt(2 * (x["k"] - 1) + 4 * shift))
        uneven = _upper_tail((chi - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1)))
        last = (x["n"] - 1).cast("int")
        mean = x["m"]
        spread = total(F.transform(x["v"], lambda v: (v - mean) * (v - mean)))
        following = F.zip_with(F.slice(x["v"], F.lit(1), last), F.slice(x["v"], F.lit(2), last), lambda a, b: (a - mean) * (b - mean))
        serial = F.when(spread > 0, total(following) / spread * F.sqrt(x["n"])).otherwise(1e3)
        high = total(F.transform(x["v"], lambda v: (v * 2 >= x["k"] - 1).cast("double")))
        low = x["n"] - high
        changes = F.zip_with(F.slice(x["v"], F.lit(1), last), F.slice(x["v"], F.lit(2), last), lambda a, b: ((a * 2 >= x["k"] - 1) != (b * 2 >= x["k"] - 1)).cast("double"))
        middle = 2 * high * low / x["n"]
        width = middle * (middle - 1) / (x["n"] - 1)
        runs = F.when(width > 0, (total(changes) - middle) / F.sqrt(width)).otherwise(1e3)
        least = F.least(uneven, 2 * _upper_tail(F.abs(serial)), 2 * _upper_tail(F.abs(runs)))
        return F.struct(natural.alias("natural"), least.alias("consistent"))

    def widened(x: Column, name: str, value: Column, *names: str) -> Column:
        return F.struct(*(x[c].alias(c) for c in names), value.alias(name))

    # One step after another, so that no sum over a token is repeated for each of its symbols.
    coded = F.transform(F.array(base), lambda x: widened(x, "v", codes(x), "s", "n", "a", "k", "c"))
    centred = F.transform(coded, lambda x: widened(x, "m", total(x["v"]) / x["n"], "s", "n", "a", "k", "c", "v"))
    return F.transform(centred, tests)[0]


def _stratum(length: Column, config: SecretConfig) -> Column:
    return sum(((length >= edge).cast("int") for edge in config.strata), F.lit(0))


def find_secrets(docs: DataFrame, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: id, kept (a struct of the ``keep`` columns), text (null unless asked for), base and ``spans``, array<struct<start, rank, end, p>>.

    Spans are in code points, end exclusive, sorted by start and then kind (``rank`` is
    the kind's place in KINDS). ``p`` is null for the fixed patterns. Null and empty texts
    have no spans; an empty table gives no rows; equal rows are reported one by one.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("body"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in keep)).alias("kept") if keep else F.lit(None).cast("string").alias("kept"))
    body = F.col("body")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("length", T.IntegerType())])

    def shaped(found: Column, rank: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(None).cast("double").alias("p"), (x["end"] - x["start"]).alias("length")))

    assigned = F.filter(_find(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= 8)
    tokens = rf"(?<![A-Za-z0-9+/_\x01-])[A-Za-z0-9+/_\x01-]{{{config.shortest},}}+={{0,2}}"
    base = F.array_sort(F.concat(shaped(assigned, 0), shaped(_find(body, ACCESS), 1), shaped(_find(body, HEX), 2)))
    # A token that meets a base span has covered characters.
    covered = _replaced(F.translate(body, COVER, " "), F.col("base"), lambda s, at: F.repeat(F.lit(COVER), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))
    scanned = source.select("*", base.alias("base")).select("*", covered.alias("covered")).select("*", _find(F.col("covered"), tokens).alias("tokens"))
    outside = F.filter("tokens", lambda t: ~F.contains(t["token"], F.lit(COVER)))
    tested = F.transform(outside, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _battery(t["token"]).alias("test")))


    def value(test: Column) -> Column:
        """p rounded up to the grid; 1 where runs, correlation or unevenness speak against randomness."""
        up = F.pow(F.lit(10.0), -F.floor(-F.log10(F.greatest(test["natural"], F.lit(1e-300))) * config.grid) / config.grid)
        return F.when(test["consistent"] >= config.consistent, up).otherwise(1.0)

    rounded = F.transform(tested, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end"), value(t["test"]).alias("p"), (t["end"] - t["start"]).alias("length")))
    path = common.shared_dir(spark)
    found = common.store(scanned.select("id", "kept", "text" if with_text else F.lit(None).cast("string").alias("text"), "base", rounded.cast(T.ArrayType(span)).alias("more")), f"{path}/found")

    candidates = found.where("size(more) > 0").select(F.explode("more").alias("t")).select(_stratum(F.col("t.length"), config).alias("stratum"), F.col("t.p").alias("p"))
    grid = candidates.groupBy("stratum", "p").agg(F.count("*").alias("rows"))
    order = W.partitionBy("stratum").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    passed = grid.withColumn("upto", F.sum("rows").over(order)).withColumn("all", F.sum("rows").over(W.partitionBy("stratum")))
    # One row a stratum at most.
    cuts = {r["stratum"]: r["cut"] for r in passed.where(F.col("p") <= config.rate * F.col("upto") / F.col("all")).groupBy("stratum").agg(F.max("p").alias("cut")).collect()}

    def limit(length: Column) -> Column:
        chosen = F.lit(None).cast("double")
        for stratum, value in cuts.items():
            chosen = F.when(_stratum(length, config) == stratum, F.lit(value)).otherwise(chosen)
        return chosen

    extra = F.filter("more", lambda t: F.coalesce(t["p"] <= limit(t["length"]), F.lit(False)))
    spans = F.array_sort(F.concat("base", extra))
    return found.select("id", "kept", "text", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row (see find_secrets)."""

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    found = find_secrets(docs, config, id_col, text_col)
    digest = F.sha2(written(F.col("base")).cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; spans that overlap become one.

    All rows and columns stay; a null text stays null.
    """
    names = docs.columns
    others = tuple(c for c in names if c not in (id_col, text_col))
    found = find_secrets(docs, config, id_col, text_col, keep=others, with_text=True)

    clean = _replaced(F.col("text"), F.col("spans"), lambda s, at: F.when(s["start"] >= at, F.lit(mark)).otherwise(""))
    return found.select(*(clean.alias(c) if c == text_col else F.col("id").alias(c) if c == id_col else F.col("kept").getField(c).alias(c) for c in names))
