"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words without outer punctuation and the stems (first
bytes) of longer words, hashed to a fixed number of buckets. The model adds to the
linear weights a factor vector per bucket, whose pairwise products score terms that
are harmless alone and toxic together.

A term gets weights and factors on either of two grounds: it is surely more frequent among
toxic training rows than among others, or it is part of a pair of terms whose rows are toxic
surely more, or less, often than the weights of single terms alone explain. The second ground
keeps terms without any share of their own in toxicity, such as a group's name, and terms that
take it away. All others are left out, so length alone moves no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from nearvote.llm import common, text

_U = np.uint64


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_rows``: bound of the labelled sample a model is fitted on (least hashes of their ids).

    ``min_z``: least deviations between a term's shares in both kinds of rows. ``pair_z``: least
    deviations between a pair's toxic rows and those that its two terms explain when apart; pairs
    are formed of all terms of ``pair_rows`` rows or more, but of nine tenths at most, that meet in
    as many rows.
    """

    buckets: int = 1 << 20
    stem: int = 5
    factors: int = 8
    max_rows: int = 20_000
    min_z: float = 4.0
    pair_z: float = 8.0
    pair_rows: int = 10
    epochs: int = 30
    batch: int = 16
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """``slots``: bucket -> index of its weights, or -1; at most as many as there are buckets."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def terms(column: pa.Array, config: ToxicityConfig) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per group of rows: number of rows, and the distinct (row, bucket) pairs in order."""
    data, offsets = text.buffers(column)
    for a, b in text.groups(offsets):
        words = text.Spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        starts, ends = words.cores()
        rows = words.rows()
        full = ends > starts
        long = ends - starts > config.stem
        whole = words.hash_spans(starts[full], ends[full])
        stems = text.mix(words.hash_spans(starts[long], starts[long] + config.stem) + _U(1))
        bucket = np.concatenate([whole, stems]) % _U(config.buckets)
        pairs = np.unique(np.concatenate([rows[full], rows[long]]).astype(_U) * _U(config.buckets) + bucket)
        yield b - a, (pairs // _U(config.buckets)).astype(np.int64), (pairs % _U(config.buckets)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, config: ToxicityConfig, id_col: str, text_col: str, label_col: str, fold: int | None) -> DataFrame:
    """(id, toxic, text) of at most ``max_rows`` labelled rows outside the held-out fold."""
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if fold is not None:
        marks = marks.where(common.fold("id", fold) != 0)
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(config.max_rows)
    rows = common.documents(docs, id_col, text_col)
    # Ids may repeat: as many of them, in that order, as have max_rows rows together; of the
    # first one beyond, any rows that are left to take.
    copies = rows.join(F.broadcast(marks), "id").groupBy("id", "toxic").agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(W.orderBy(F.xxhash64("id"), "id"))  # max_rows rows at most
    counted = [(r["id"], r["toxic"], r["copies"], r["upto"]) for r in copies.withColumn("upto", upto).where(F.col("upto") - F.col("copies") < config.max_rows).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i, y) for i, y, _, upto in counted if upto <= config.max_rows], "id long, toxic int")
    out = rows.join(F.broadcast(chosen), "id")
    for i, y, n, upto in counted:
        if upto > config.max_rows:
            out = out.unionByName(rows.where(F.col("id") == i).limit(config.max_rows - (upto - n)).select("id", "text", F.lit(y).alias("toxic")))
    return out.select("id", "text", "toxic")


def train(rows: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Model:
    """Fit on (id, toxic, text) rows, a bounded sample: their term lists come to the driver.

    Without rows of both kinds the model scores every text with the share of toxic rows
    (0 without any).
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for n, rows, bucket in terms(batch.column(2), config):
                cut = np.searchsorted(rows, np.arange(n + 1))
                raw = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.record_batch([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(raw, pa.binary())], names=["id", "toxic", "terms"])
                row += n

    got = rows.select("id", "toxic", "text").mapInArrow(scan, schema).toArrow().sort_by([("id", "ascending"), ("terms", "ascending")])
    labels = np.array(got.column("toxic").to_pylist(), np.float64).clip(0, 1)
    lists = [np.frombuffer(x.as_py(), "<i4") for x in got.column("terms")]
    del got
    return fit(lists, labels, config, rows.sparkSession)


def fit(lists: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig, spark: SparkSession | None = None) -> Model:
    """Screen the buckets, then AdaGrad on the logistic loss, a few rows at a time.

    Pairs are screened by ``spark``'s tasks if it is given."""
    slots = np.full(config.buckets, -1, np.int32)
    positive, n = labels.sum(), len(labels)
    share = positive / n if n else 0.0
    if not 0 < positive < n:
        return Model(float(_logit(share)), slots, np.zeros(0), np.zeros((0, config.factors)))
    with_term = np.zeros(config.buckets)
    toxic_with = np.zeros(config.buckets)
    for x, y in zip(lists, labels):
        with_term[x] += 1
        toxic_with[x] += y
    p, q = toxic_with / positive, (with_term - toxic_with) / (n - positive)
    pooled = with_term / n
    deviation = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / positive + 1 / (n - positive)), 1e-12))
    alone = np.flatnonzero((p - q) / deviation >= config.min_z)
    explained = linear(lists, labels, alone, config)
    return descend(lists, labels, np.union1d(alone, paired(lists, labels, explained, with_term, config, spark)), config)


def linear(lists: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, config: ToxicityConfig, steps: int = 200) -> np.ndarray:
    """Chances of the rows by weights of the ``kept`` buckets alone, all rows at a time."""
    n, at = len(labels), np.full(config.buckets, -1, np.int32)
    at[kept] = np.arange(len(kept))
    short = [s[s >= 0] for s in (at[x] for x in lists)]
    rows, slot = np.repeat(np.arange(n), [len(s) for s in short]), np.concatenate(short)
    values, grown = np.zeros(len(kept) + 1), np.full(len(kept) + 1, 1e-6)
    values[-1] = _logit(labels.mean())
    for _ in range(steps):
        z = values[-1] + np.bincount(rows, values[slot], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(np.bincount(slot, (p - labels)[rows], len(kept)), (p - labels).sum())
        grown += g * g
        values -= 0.5 * g / np.sqrt(grown)
    return p


class Meetings:
    """The sample's rows as lists of frequent terms, each row's residual and variance under single
    terms, and their sums by term. A term's rows are found where its pairs are counted."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, count: int, residual: np.ndarray, variance: np.ndarray):
        self.first, self.terms, self.residual, self.variance = first, terms, residual, variance
        self.rows, self.sums, self.spreads = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
        for a in range(0, len(first) - 1, 1024):
            size = np.diff(first[a : a + 1025])
            own = terms[first[a] : first[a] + size.sum()]
            self.rows += np.bincount(own, minlength=count)
            self.sums += np.bincount(own, np.repeat(residual[a : a + 1024], size), count)
            self.spreads += np.bincount(own, np.repeat(variance[a : a + 1024], size), count)

    def holders(self, low: int, high: int) -> list[np.ndarray]:
        """The rows of each of the terms ``low`` to ``high`` - 1."""
        at = np.flatnonzero((self.terms >= low) & (self.terms < high))
        at = at[np.argsort(self.terms[at], kind="stable")]
        return np.split(np.searchsorted(self.first, at, "right") - 1, np.cumsum(self.rows[low:high])[:-1])

    def partners(self, term: int, own: np.ndarray, config: ToxicityConfig) -> np.ndarray:
        """The terms that ``term`` forms a telling pair with; ``own`` are its rows.

        What the rows of a pair have over the explained is compared with what each of its terms
        has in its rows without the other: only what neither explains counts.
        """
        m = len(self.rows)
        n, over, spread = (np.zeros(m) for _ in range(3))
        for a in range(0, len(own), 1024):
            part = own[a : a + 1024]
            size = self.first[part + 1] - self.first[part]
            at = np.arange(size.sum()) + np.repeat(self.first[part] - (np.cumsum(size) - size), size)
            met = self.terms[at]
            n += np.bincount(met, minlength=m)
            over += np.bincount(met, np.repeat(self.residual[part], size), m)
            spread += np.bincount(met, np.repeat(self.variance[part], size), m)
        some = np.flatnonzero(n >= config.pair_rows)
        some = some[some != term]
        n, over, spread = n[some], over[some], spread[some]
        net, doubt = over.copy(), 1 + spread
        for x in (term, some):
            total, sums, variances = self.rows[x], self.sums[x], self.spreads[x]
            apart = total - n
            scale = np.where(apart > 0, n / np.maximum(apart, 1), 0)
            net -= scale * (sums - over)
            doubt += scale * scale * np.maximum(variances - spread, 0)
        return some[np.abs(net) >= config.pair_z * np.sqrt(doubt)]


def paired(lists: list[np.ndarray], labels: np.ndarray, explained: np.ndarray, with_term: np.ndarray, config: ToxicityConfig, spark: SparkSession | None = None) -> np.ndarray:
    """Buckets of the pairs whose rows are toxic more or less often than their terms explain."""
    n = len(labels)
    some = np.flatnonzero((with_term >= config.pair_rows) & (with_term <= 0.9 * n))
    if not len(some):
        return some
    at = np.full(config.buckets, -1, np.int32)
    at[some] = np.arange(len(some))
    short = [s[s >= 0] for s in (at[x] for x in lists)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in short])])
    terms = np.concatenate([np.zeros(0, np.int32), *short])
    del short
    meetings = Meetings(first, terms, len(some), labels - explained, explained * (1 - explained))
    if spark is None:
        told = [np.append(found, t) for t, own in enumerate(meetings.holders(0, len(some))) if len(found := meetings.partners(t, own, config))]
        return some[np.unique(np.concatenate([np.zeros(0, np.int64), *told]).astype(np.int64))]
    shared = spark.sparkContext.broadcast(meetings)  # of the bounded sample

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = batch.column(0)[0].as_py()  # a task's terms follow one another
            for t, own in enumerate(shared.value.holders(low, low + batch.num_rows), low):
                found = shared.value.partners(t, own, config)
                if len(found):
                    yield pa.record_batch([pa.array(np.append(found, t), pa.int64())], names=["term"])

    tasks = max(1, min(len(some), 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(some), 1, tasks).mapInArrow(search, "term long").distinct().toArrow()
    shared.destroy()
    return some[np.sort(found.column("term").to_numpy())]


def descend(lists: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, config: ToxicityConfig) -> Model:
    """The model of the ``kept`` buckets."""
    slots = np.full(config.buckets, -1, np.int32)
    slots[kept] = np.arange(len(kept))
    rng = np.random.default_rng(config.seed)
    weights, factors = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), config.factors))
    grown, grown_factors = np.full(len(kept), 1e-6), np.full(factors.shape, 1e-6)
    bias, grown_bias = float(_logit(labels.mean())), 1e-6
    short = [s[s >= 0] for s in (slots[x] for x in lists)]
    for _ in range(config.epochs):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), config.batch):
            own = order[begin : begin + config.batch]
            sizes = np.array([len(short[i]) for i in own])
            row, at = np.repeat(np.arange(len(own)), sizes), np.concatenate([short[i] for i in own])
            z = np.full(len(own), bias)
            if at.size:
                v = factors[at]
                some = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[some]
                total = np.zeros((len(own), config.factors))
                total[some] = np.add.reduceat(v, first)
                z += np.bincount(row, weights[at], len(own))
                z[some] += 0.5 * ((total[some] ** 2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), first))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
            step = g.sum()
            grown_bias += step * step
            bias -= config.rate * step / np.sqrt(grown_bias)
            if at.size:
                by_term = np.argsort(at, kind="stable")
                used, first = np.unique(at[by_term], return_index=True)
                gw = np.add.reduceat(g[row][by_term], first) + config.decay * weights[used]
                grown[used] += gw * gw
                weights[used] -= config.rate * gw / np.sqrt(grown[used])
                gv = np.add.reduceat((g[row, None] * (total[row] - v))[by_term], first) + config.decay * factors[used]
                grown_factors[used] += gv * gv
                factors[used] -= config.rate * gv / np.sqrt(grown_factors[used])
    return Model(float(bias), slots, weights, factors)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return np.log(p / (1 - p))


def probabilities(model: Model, n: int, rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    slot = model.slots[bucket]
    rows, slot = rows[slot >= 0], slot[slot >= 0]
    z = model.bias + np.bincount(rows, model.weights[slot], n)
    for f in range(model.factors.shape[1]):
        v = model.factors[slot, f]
        z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: chance that the text is toxic.

    A null or empty text gets the model's base rate. All rows and other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sized by config.buckets
    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema][:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [probabilities(shared.value, *group) for group in terms(batch.column(names.index(text_col)), config)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], names=[*names, out])

    return docs.select(*names).mapInArrow(scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows of fold 0 teach nothing.

    Learns from a bounded sample (``max_rows``) of the labelled rows. Null labels and
    labels of unknown ids are ignored; of several labels of an id the highest counts.
    """
    model = train(sample(docs, labels, config, id_col, text_col, label_col, fold), config)
    rows = common.documents(docs, id_col, text_col)
    scored = score(rows, model, config, "id", "text")
    return scored.select(F.col("id").alias("doc_id"), (common.fold("id", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
