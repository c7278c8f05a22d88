"""Scalar rules of scoring: half-even rounding, normalising, verdicts and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearvote.config import DENY_AT


def round4(x: Column) -> Column:
    """Four decimals, halves to even (``round`` would take halves away from zero)."""
    return F.rint(x * F.lit(10000.0)) / F.lit(10000.0)


def share(x: Column, most: float) -> Column:
    """x / most, clamped to [0, 1] and rounded."""
    return round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") / F.lit(float(most)))))


def approved(fraud_count: Column) -> Column:
    return fraud_count < DENY_AT


def fraud_score(fraud_count: Column) -> Column:
    """A fifth for each fraud; counts outside 0 to 5 score 0."""
    return F.when(fraud_count.between(0, 5), F.round(fraud_count * F.lit(0.2), 1)).otherwise(F.lit(0.0))


def response(fraud_count: Column) -> Column:
    """The response document as JSON text."""
    return F.to_json(F.struct(approved(fraud_count).alias("approved"), fraud_score(fraud_count).alias("fraud_score")))
