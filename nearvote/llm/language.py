"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

The byte trigrams of the training texts' words, and the words of each script, are counted
per language in hashed tables of fixed size, over all training rows. A word's score for a language is the
log-probability of its trigrams, relative to its best language. The script of a word's
letters narrows its candidates to the languages seen in that script. Viterbi then finds
the labelling of the whole text that maximises the scores minus a penalty for every
switch, so single odd words don't split a passage and longer foreign passages do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.llm import common, text

_U = np.uint64
#: Scripts by the first bytes of their UTF-8 ranges: (name, lead bytes, second bytes or None).
SCRIPTS = (
    ("latin", range(0xC3, 0xCA), None),
    ("greek", range(0xCD, 0xD0), None),
    ("cyrillic", range(0xD0, 0xD5), None),
    ("hebrew", range(0xD6, 0xD8), None),
    ("arabic", range(0xD8, 0xDD), None),
    ("indic", (0xE0,), range(0xA4, 0xB8)),
    ("thai", (0xE0,), range(0xB8, 0xBC)),
    ("kana", (0xE3,), range(0x81, 0x84)),
    ("han", range(0xE4, 0xEA), None),
    ("hangul", range(0xEA, 0xEE), range(0x80, 0xC0)),
)
N_SCRIPTS = len(SCRIPTS) + 2  # 0: no letter, then SCRIPTS, last: any other


def _script_table() -> np.ndarray:
    table = np.zeros((256, 256), np.int8)
    table[0xC2:0xF5] = N_SCRIPTS - 1
    for i, (_, leads, seconds) in enumerate(SCRIPTS, 1):
        for lead in leads:
            table[lead, list(seconds) if seconds else slice(None)] = i
    table[ord("a") : ord("z") + 1] = 1
    return table


SCRIPT_OF = _script_table()


@dataclass(frozen=True)
class LanguageConfig:
    """``switch``: penalty of a change of language between two words, in nats. ``min_share``:
    least share of a language's own words that a script has to hold to be one of its. A table
    with more than ``max_languages`` distinct labels is an error, none is left out."""

    buckets: int = 1 << 16
    switch: float = 12.0
    floor: float = 10.0
    smoothing: float = 0.1
    min_share: float = 0.001
    max_languages: int = 1000


@dataclass(frozen=True)
class Model:
    """``scores``: (buckets, languages); ``allowed``: (scripts, languages)."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray


def word_features(words: text.Words | Piece, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram that ends at each byte of a word, the word of that byte, script of each word).

    A trigram does not look beyond its word's start: a space stands for what is before.
    """
    starts, ends, data = words.starts, words.ends, words.data
    lengths = ends - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else np.zeros(0, np.int64)
    place = np.arange(len(word)) - first[word]
    at = starts[word] + place
    a = data[at].astype(np.uint32)
    b = np.where(place > 0, data[np.maximum(at - 1, 0)], 32).astype(np.uint32)
    c = np.where(place > 1, data[np.maximum(at - 2, 0)], 32).astype(np.uint32)
    # Punctuation tells nothing about a language.
    bucket = ((a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) >> np.uint32(7)) % np.uint32(buckets)
    following = np.append(data[1:], 0)[at] if len(data) else a
    letter = SCRIPT_OF[a, following]
    scripts = np.zeros(len(starts), np.int8)
    if len(word):
        # The script of a word is that of its first letter.
        seen = np.flatnonzero(letter > 0)
        owner, where = np.unique(word[seen], return_index=True)
        scripts[owner] = letter[seen[where]]
    keep = (letter > 0) | (a >= 0x80)
    return bucket[keep].astype(np.int64), word[keep], scripts


#: Languages whose tables a task holds before it sends them on.
HELD = 64


def train(rows: DataFrame, config: LanguageConfig = LanguageConfig()) -> Model:
    """Count over all rows (text, lang) with a language. What reaches the driver has the
    size buckets * languages, whatever the number of rows."""
    labels = rows.where("lang is not null").select("lang").distinct().limit(config.max_languages + 1)
    languages = tuple(sorted(r["lang"] for r in labels.collect()))
    if len(languages) > config.max_languages:
        raise ValueError(f"more than {config.max_languages} languages")
    index = {x: i for i, x in enumerate(languages)}
    width = config.buckets + N_SCRIPTS
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            own = sorted(counts)
            return pa.record_batch([pa.array(own, pa.int32()), pa.array([counts[i].tobytes() for i in own], pa.binary())], names=["block", "payload"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, words in text.iterate(batch.column(0)):
                bucket, word, scripts = word_features(words, config.buckets)
                owner = np.array([index.get(x, -1) for x in langs[a:b]], np.int64)[words.rows()]
                for i in np.unique(owner[owner >= 0]).tolist():
                    if i not in counts:
                        if len(counts) >= HELD:
                            yield send()
                            counts.clear()
                        counts[i] = np.zeros(width, np.int64)
                    counts[i][: config.buckets] += np.bincount(bucket[owner[word] == i], minlength=config.buckets)
                    counts[i][config.buckets :] += np.bincount(scripts[owner == i], minlength=N_SCRIPTS)
        yield send()

    totals = np.zeros((len(languages), width), np.float64)
    if languages:
        for i, vector in common.add_up(rows.where("lang is not null").select("text", "lang").mapInArrow(scan, schema), "block", "payload", "<i8", "add", 16).items():
            totals[i] = vector
    grams = totals[:, : config.buckets].T + config.smoothing
    scores = np.log(grams / grams.sum(axis=0, keepdims=True)) if languages else grams
    words = totals[:, config.buckets :].T
    # Of a language's words with letters: how much text other languages have doesn't matter.
    allowed = words >= config.min_share * np.maximum(words[1:].sum(axis=0, keepdims=True), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, scores.astype(np.float32), allowed)


def emissions(model: Model, words: text.Words | Piece, config: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores relative to the best candidate, and which words have letters."""
    bucket, word, scripts = word_features(words, config.buckets)
    n, k = len(words.starts), len(model.languages)
    out = np.zeros((n, k), np.float32)
    for i in range(k):
        out[:, i] = np.bincount(word, model.scores[bucket, i], n)
    out[~model.allowed[scripts]] = -np.inf
    out -= out.max(axis=1, keepdims=True)
    np.maximum(out, -config.floor, out=out)
    out[scripts == 0] = 0
    return out, scripts > 0


def _step(now: np.ndarray, switch: float, same: np.ndarray, back: np.ndarray | None = None) -> None:
    """One word on: values relative to the best label, none more than ``switch`` below it, so that
    they stay exact in long texts. ``back`` gets where each label comes from."""
    top = now.argmax(axis=1)[:, None]
    now -= np.take_along_axis(now, top, axis=1)
    if back is not None:
        back[...] = np.where(now >= -np.float32(switch), same, top.astype(np.int16))
    np.maximum(now, -np.float32(switch), out=now)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; rows of ``scores`` are words, ``first`` where documents begin.

    All documents take their n-th word together, the longest ones first in order.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, ordered = first[:-1][order], lengths[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores) or scores.shape[1] < 2:
        return labels
    k = scores.shape[1]
    longest = int(ordered[0])
    active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(longest), "right")
    back = np.empty((len(scores), k), np.int16)
    best = np.zeros((len(ordered), k), np.float32)
    same = np.arange(k, dtype=np.int16)
    for t in range(longest):
        m = active[t]
        now = best[:m]
        at = starts[:m] + t
        if t:
            came = np.empty((m, k), np.int16)
            _step(now, switch, same, came)
            back[at] = came
        now += scores[at]
    label = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        labels[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return labels


@dataclass(frozen=True)
class Piece:
    """Consecutive words of a text and the bytes that they stand in."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _piece(words: text.Words, a: int, b: int) -> Piece:
    low = words.starts[a]
    return Piece(words.data[low : words.ends[b - 1] + 1], words.starts[a:b] - low, words.ends[a:b] - low)


def label_long(model: Model, words: text.Words, config: LanguageConfig, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``emissions`` and ``viterbi`` make of one text, (labels, which words have letters), with
    ``size`` words in memory at a time.

    A first pass keeps the values before each block of words; a second one runs the blocks
    again, the last first, and follows their back pointers.
    """
    n, k = len(words.starts), len(model.languages)
    labels, lettered = np.zeros(n, np.int16), np.zeros(n, bool)
    same, cuts, kept = np.arange(k, dtype=np.int16), range(0, n, size), []
    best = np.zeros((1, k), np.float32)

    def run(a: int, b: int, back: np.ndarray | None) -> None:
        scores, lettered[a:b] = emissions(model, _piece(words, a, b), config)
        for t in range(b - a):
            if a + t:
                _step(best, config.switch, same, None if back is None else back[t : t + 1])
            best[0] += scores[t]

    for a in cuts:
        kept.append(best.copy())
        run(a, min(a + size, n), None)
    label = int(best.argmax())
    for a, best in zip(reversed(cuts), reversed(kept)):
        b = min(a + size, n)
        back = np.empty((b - a, k), np.int16)
        run(a, b, back)
        for t in range(b - a - 1, -1, -1):
            labels[a + t] = label
            if a + t:
                label = int(back[t, label])
    return labels, lettered


#: Bytes of text whose documents are labelled together, and bytes times languages. Of a longer text
#: the words are labelled in blocks of LONG words times languages.
TOGETHER, CELLS, LONG = 4 << 20, 64 << 20, 8 << 20


def _has_letter(value: str) -> bool:
    return any(c.isalpha() for c in value)


def label_languages(docs: DataFrame, model: Model, config: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row.

    ``spans`` has (lang, first_word, end_word) for every run of words with one label;
    ``lang_pred`` is the label of most words with letters (ties: the first by name),
    ``score`` their share. A text that is null or without a letter gets ``und``, score 0
    and no spans; so does every text if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * languages
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())])))])

    def named(column: pa.Array, a: int, first: np.ndarray, labels: np.ndarray, lettered: np.ndarray) -> Iterator[tuple[str, float, list]]:
        """Language, share and spans of the rows from ``a`` on, whose words begin at ``first``."""
        names, k = shared.value.languages, len(shared.value.languages)
        for row, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), a):
            own = labels[x:y]
            votes = np.bincount(own[lettered[x:y]], minlength=k)
            # Letters of scripts that no table knows are looked for one by one.
            if not votes.sum() and not _has_letter(column[row].as_py() or ""):
                yield "und", 0.0, []
                continue
            if not votes.sum():
                votes = np.bincount(own, minlength=k)
            best = int(votes.argmax())
            cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [y - x]))
            spans = [{"lang": names[own[i]], "first_word": i, "end_word": j} for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield names[best], float(votes[best] / votes.sum()), spans

    def label(column: pa.Array) -> Iterator[tuple[str, float, list]]:
        model = shared.value
        k = len(model.languages)
        data, offsets = text.buffers(column)
        if not k:
            yield from (("und", 0.0, []) for _ in range(len(column)))
            return
        limit = min(TOGETHER, CELLS // k)
        for a, b in text.groups(offsets, limit):
            if offsets[b] - offsets[a] > limit:  # a single text
                words = text.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield from named(column, a, words.first, *label_long(model, words, config, max(1, LONG // k)))
                continue
            parts, letters, firsts = [], [], [0]
            for c, d in text.groups(offsets[a : b + 1]):
                words = text.Words(data[offsets[a + c] : offsets[a + d]], offsets[a + c : a + d + 1] - offsets[a + c])
                scores, lettered = emissions(model, words, config)
                parts.append(scores)
                letters.append(lettered)
                firsts.extend((firsts[-1] + words.first[1:]).tolist())
            first, lettered = np.array(firsts), np.concatenate(letters)
            yield from named(column, a, first, viterbi(np.concatenate(parts), first, config.switch), lettered)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(label(batch.column(1)))
            columns = [list(x) for x in zip(*found)] or [[], [], []]
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return common.documents(docs, id_col, text_col).select("id", "text").mapInArrow(scan, schema)


def identify_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of every row; the held-out fold teaches nothing."""
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = train(known.where((common.fold("id", folds) != held) & F.col("text").isNotNull()), config)
    found = label_languages(docs, model, config, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), (common.fold("id", folds) == held).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
