"""Vector expressions: fixed point, distances, bounds and profile keys. All are Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearvote.config import SCALE


def quantize(vec: Column, scale: int = SCALE) -> Column:
    """Half-even fixed point, clamped to 16 bits before the cast (ANSI casts would fail)."""
    return F.transform(vec, lambda x: F.greatest(F.least(F.rint(x.cast("double") * scale), F.lit(32767.0)), F.lit(-32768.0)).cast("int"))


def squared_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared Euclidean distance. With known ``dims`` the sum is unrolled, so that it is
    compiled; else it is folded over the arrays."""
    if dims is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    terms = [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(dims)]
    return reduce(lambda s, x: s + x, [t * t for t in terms])


def partial_distance(a: Column, b: Column, start: int, count: int) -> Column:
    """Squared distance over ``count`` dimensions from ``start``: never more than the whole. Unrolled, so that it is compiled."""
    terms = [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))).cast("double") for i in range(start, start + count)]
    return reduce(lambda s, x: s + x, [t * t for t in terms])


def box_bound(q: Column, low: Column, high: Column) -> Column:
    """Least squared distance from ``q`` to any point of the box: the squared gaps summed.

    Folded over the arrays: it runs once per query and cluster, where an unrolled sum
    would cost more to compile than to run.
    """
    under = F.zip_with(low, q, lambda lo, x: F.greatest(lo - x, F.lit(0)))
    over = F.zip_with(q, high, lambda x, hi: F.greatest(x - hi, F.lit(0)))
    return F.aggregate(F.zip_with(under, over, lambda a, b: (a + b).cast("double") * (a + b)), F.lit(0.0), lambda s, x: s + x)


def bucket(value: Column, n: int) -> Column:
    """Bucket 0 .. n - 1 of a fixed-point value in [0, SCALE]."""
    scaled = (value.cast("long") * n / (SCALE + 1)).cast("int")
    return F.when(value <= 0, F.lit(0)).otherwise(F.least(F.lit(n - 1), scaled))


# What each group of bits of a profile key says, lowest bits first.
# (width, dimension, kind): bN buckets, or a sign test.
PROFILE_LAYOUT = (
    (4, 2, "b16"),
    (3, 7, "b8"),
    (2, 8, "b4"),
    (2, 12, "b4"),
    (2, 0, "b4"),
    (1, 5, "negative"),
    (1, 9, "positive"),
    (1, 10, "positive"),
    (1, 11, "positive"),
    (2, 6, "b4"),
    (1, 1, "above410"),
    (2, 13, "b4"),
)


def profile_key(q: Column) -> Column:
    """22-bit key of a quantised feature vector."""
    key, shift = F.lit(0), 0
    for width, dim, kind in PROFILE_LAYOUT:
        x = F.get(q, F.lit(dim))
        if kind.startswith("b"):
            part = bucket(x, int(kind[1:]))
        else:
            part = {"negative": x < 0, "positive": x > 0, "above410": x > 410}[kind].cast("int")
        key = key.bitwiseOR(F.shiftleft(part, shift))
        shift += width
    return key


def text_of(vec: Column) -> Column:
    """A vector of integers as comma-separated text."""
    return F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")
