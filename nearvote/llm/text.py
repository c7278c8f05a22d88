"""Vectorised byte-level tokenising shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so a batch of
documents costs a handful of numpy passes instead of a Python loop over words.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after mapping A-Z to
a-z; a multi-byte character never contains such a byte, so this equals the
character-level pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that one numpy pass works on, unless a single document is longer.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply); wraps silently, as uint64 arrays do."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=_U) * _STEP)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


class Words:
    """Words of a few whole documents: byte spans, owning row and 64-bit hash.

    ``inside`` tells the bytes (after lower-casing) that words are made of.
    """

    __slots__ = ("data", "starts", "ends", "first", "hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE):
        self.data = data = LOWER[data]
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, _U)
            self.first = np.zeros(len(offsets), np.int64)
            return
        solid = inside[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:n]
        finish = solid.copy()
        finish[:-1] &= ~solid[1:] | cut[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        power, inverse = _power_tables(n)
        total = np.empty(n + 1, dtype=_U)
        total[0] = 0
        np.cumsum(_SYMBOL[data] * power[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        #: Index of each row's first word; one more entry closes the last row.
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``k`` consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(k), dtype=_U) * _STEP
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct ``k``-word shingles as sorted hashes.

    A row of fewer words has its whole sequence as its only shingle, a row without
    words the empty set.
    """
    runs = chain(words.hashes, k)
    first = words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield chain(words.hashes[a:b], b - a)
        else:
            yield runs[:0]


def iterate(column: pa.Array, limit: int = CHUNK, inside: np.ndarray = ~SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive groups of whole documents."""
    data, offsets = buffers(column)
    for a, b in groups(offsets, limit):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], inside)


_CORE = np.ones(256, dtype=bool)
_CORE[:128] = [chr(i).isalnum() for i in range(128)]


class Spans(Words):
    """Words that can also hash other byte spans of their buffer."""

    __slots__ = ("_total",)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        n = len(self.data)
        power, _ = _power_tables(n)
        self._total = np.zeros(n + 1, dtype=_U)
        np.cumsum(_SYMBOL[self.data] * power[:n], out=self._total[1:])

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = _power_tables(len(self.data))
        return mix((self._total[ends] - self._total[starts]) * inverse[starts])

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word without the ASCII punctuation at its ends (start = end: nothing is left)."""
        n = len(self.data)
        if not n:
            return self.starts, self.ends
        at = np.arange(n)
        core = _CORE[self.data]
        last = np.maximum.accumulate(np.where(core, at, -1))[self.ends - 1] + 1
        following = np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1][self.starts]
        starts = np.minimum(following, self.ends)
        return starts, np.maximum(last, starts)
