"""Packing: optimal length buckets and token-budget batches.

Rows of a batch are padded to their bucket's upper length. A dynamic program over the
global histogram of lengths chooses the bucket boundaries that minimise the padding; with
the lengths sorted, the best last boundary moves monotonically, so each layer is solved
by divide and conquer. Within a bucket the rows are numbered without gaps and cut into
batches of as many rows as the token budget holds at the bucket's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.llm import common


@dataclass(frozen=True)
class PackingConfig:
    buckets: int = 8
    budget: int = 16_384


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``lengths`` are distinct and ascending. Of several optima the one whose last
    boundaries are least wins.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    layers = min(buckets, n)
    # cost[j]: least padding of the first j lengths in the layers so far.
    cost = np.empty(n + 1, np.int64)
    cost[0] = 0
    cost[1:] = lengths * rows[1:] - tokens[1:]
    cuts = []
    for layer in range(2, layers + 1):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max), np.zeros(n + 1, np.int64)
        todo = [(layer, n, layer - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            padding = cost[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            best = int(padding.argmin())
            new[j], cut[j] = padding[best], i[best]
            todo.append((low, j - 1, first, int(i[best])))
            todo.append((j + 1, high, int(i[best]), last))
        cost = new
        cuts.append(cut)
    ends, j = [n], n
    for cut in reversed(cuts):
        j = int(cut[j])
        ends.append(j)
    return [int(lengths[e - 1]) for e in reversed(ends)]


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    # Only a word's first character follows a separator or the start.
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(kept) - F.length(F.translate(kept, "w", ""))


def pack(docs: DataFrame, config: PackingConfig = PackingConfig(), length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot, padding) of every row.

    ``length`` is any column expression for a row's tokens (words by default; null
    counts as 0). ``bucket`` counts from 0 by length, ``batch`` from 0 within its bucket,
    ``slot`` from 0 within its batch. A row longer than the budget has a batch of its
    own. Equal ids get slots in any order; an empty table gives no rows.

    The histogram that reaches the driver has one entry per distinct length, so it is
    bounded by the longest text.
    """
    tokens = F.coalesce((length if length is not None else word_count(docs[text_col])).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), tokens.alias("n_tokens"))
    spark = docs.sparkSession
    rows = common.store(rows, f"{common.shared_dir(spark)}/lengths")
    histogram = rows.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    bounds = optimal_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), config.buckets)
    bucket, upper = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for i, b in enumerate(bounds[1:], 1):
        beyond = F.col("n_tokens") > bounds[i - 1]
        bucket, upper = F.when(beyond, F.lit(i)).otherwise(bucket), F.when(beyond, F.lit(b).cast("long")).otherwise(upper)
    placed = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), upper.alias("bucket_length"))
    numbered = common.gapless(placed, "bucket", "doc_id", "at", config.buckets, ("n_tokens",))
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{config.budget}L div greatest(bucket_length, 1L)"))
    return numbered.withColumn("each", each).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.expr("at div each").cast("long").alias("batch"),
        (F.col("at") % F.col("each")).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
