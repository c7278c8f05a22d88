"""Deterministic k-means: positional seeds, Lloyd steps, members in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.operators import knn_kernel
from nearvote.sources.scratch import scratch_dir, written

#: Vectors that one matrix product covers.
ROWS = 256


def _numbered(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``pos``, the place of each row by ref_id, without one task seeing all.

    Quantiles of the ids cut them into ranges; each range numbers its rows and adds the
    rows before it.
    """
    bounds = sorted(set(vectors.approxQuantile("ref_id", [i / 64 for i in range(1, 64)], 0.005)))
    local = vectors.withColumn("_part", sum(((F.col("ref_id") > b).cast("int") for b in bounds), F.lit(0)))
    before = local.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = local.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy("ref_id")) - 1)
    return placed.join(F.broadcast(before.drop("count")), "_part").withColumn("pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def seeds(vectors: DataFrame, k: int) -> DataFrame:
    """(cluster_id, ref_id, centroid): the rows at places floor(c * n / k) in id order."""
    n = vectors.count()
    wanted = vectors.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"), F.expr(f"id * {n}L div {k}L").alias("pos"))
    return _numbered(vectors).join(F.broadcast(wanted), "pos").select("cluster_id", "ref_id", F.col("vec").alias("centroid"))


def assign(vectors: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """``vectors`` with cluster_id and d, the nearest centroid's; ties go to the lower cluster.

    The k centroids are broadcast (k * dims numbers) and the rows stay where they are: a map
    over Arrow batches, without a row per pair or a shuffle.
    """
    held = vectors.sparkSession.sparkContext.broadcast(_table(centroids, dims))
    at = vectors.columns.index("vec")
    schema = T.StructType([*vectors.schema, T.StructField("cluster_id", T.IntegerType()), T.StructField("d", T.DoubleType())])
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = held.value
        for batch in batches:
            to, d = nearest_one(knn_kernel.matrix(batch.column(at), dims), table)
            yield pa.record_batch([*batch.columns, pa.array(ids[to], pa.int32()), pa.array(d)], names=names)

    return vectors.mapInArrow(scan, schema)


def _table(centroids: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, centroids) in order of their ids: k * dims numbers."""
    ids, table = knn_kernel.held(centroids, "cluster_id", "centroid", dims)
    order = np.argsort(ids)
    return ids[order], table[order]


def nearest_one(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of each row's nearest centroid, the first of equal ones.

    A matrix product finds the nearest up to its rounding; rows with more than one centroid that
    near are decided by direct differences, which are summed in the order of the dimensions.
    """
    squares = (table * table).sum(axis=1)
    places = np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        near = squares[None, :] - 2 * (part @ table.T)
        reach = near.min(axis=1) + 1e-9 * (1 + squares.max() + (part * part).sum(axis=1))
        row, col = np.nonzero(near <= reach[:, None])
        first = np.searchsorted(row, np.arange(len(part)))
        own = col[first]
        many = np.bincount(row, minlength=len(part)) > 1
        if many.any():
            keep = many[row]
            row, col = row[keep], col[keep]
            order = np.lexsort((col, _apart(part[row], table[col]), row))
            row, col = row[order], col[order]
            own[row[::-1]] = col[::-1]  # the first of a row is written last
        places[a : a + ROWS] = own
    return places, _apart(x, table[places])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        d += step * step
    return d


def recompute(assigned: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster_id, cnt, centroid): member means; a cluster without members is the zero vector.

    Every task adds up its members by cluster (k * dims numbers in memory) and passes on one row a
    cluster it has seen; these rows are added up, not the members.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims)), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            x = knn_kernel.matrix(batch.column(1), dims)
            order = np.argsort(cluster, kind="stable")
            seen, first = np.unique(cluster[order], return_index=True)
            if len(seen):
                sums[seen] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        seen = np.flatnonzero(counts)
        ends = pa.array(np.arange(len(seen) + 1) * dims, pa.int32())
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(counts[seen]), pa.ListArray.from_arrays(ends, pa.array(sums[seen].ravel()))], names=["cluster_id", "n", "sums"])

    parts = assigned.select("cluster_id", F.col("vec").cast("array<double>")).mapInArrow(add, "cluster_id int, n long, sums array<double>")
    means = parts.groupBy("cluster_id").agg(F.sum("n").alias("cnt"), F.array(*(F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(dims))).alias("centroid"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    zero = F.array(*(F.lit(0.0) for _ in range(dims)))
    return every.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("centroid", zero).alias("centroid"))


CENTROIDS = "cluster_id int, centroid array<double>"


def fit(vectors: DataFrame, k: int, dims: int, iterations: int = 20, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids, assigned) after fixed Lloyd iterations and a last assignment.

    Each round's k centroids are a table in the folder ``state`` (a scratch folder by default), so
    lineage does not grow, and a fit that was stopped goes on after its last whole round when it is
    called again with the same vectors, settings and folder.
    """
    spark = vectors.sparkSession
    folder = state or scratch_dir(spark)
    if not written(spark, f"{folder}/vectors"):
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors")  # read in every round
    vectors = spark.read.schema(vectors.schema).parquet(f"{folder}/vectors")

    def round_of(i: int) -> str:
        return f"{folder}/k={k}/round={i}"

    done = next((i for i in range(iterations, -1, -1) if written(spark, round_of(i))), -1)
    for i in range(done + 1, iterations + 1):
        if i == 0:
            rows = seeds(vectors, k)
        else:
            rows = recompute(assign(vectors, spark.read.schema(CENTROIDS).parquet(round_of(i - 1)), dims), k, dims)
        rows.select("cluster_id", "centroid").write.mode("overwrite").parquet(round_of(i))
    centroids = spark.read.schema(CENTROIDS).parquet(round_of(iterations))
    return centroids, assign(vectors, centroids, dims)


def slots(assigned: DataFrame) -> DataFrame:
    """``assigned`` with ``slot``: members of a cluster by distance to its centroid."""
    return assigned.withColumn("slot", F.row_number().over(W.partitionBy("cluster_id").orderBy("d", "ref_id")) - 1)


def offsets(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster_id, cnt, start): sizes and their running sum, empty clusters included."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    sizes = every.join(assigned.groupBy("cluster_id").agg(F.count("*").alias("cnt")), "cluster_id", "left").select("cluster_id", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    running = F.sum("cnt").over(W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1))  # k rows
    return sizes.withColumn("start", F.coalesce(running, F.lit(0)))
