"""Storage, ranking and graph helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from nearvote.sources.scratch import scratch_dir


#: A fresh folder under ``spark.checkpoint.dir``; without that setting a local one in tests, an error on a cluster.
shared_dir = scratch_dir


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no result depends on any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: documents may be long, and
    a batch is held by the JVM and by Python at once. The session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names, so that others can't clash."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(docs[c] for c in more))


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (null ids read as '')."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Most rows of per-cell counts that are broadcast (about 40 bytes each).
BROADCAST_CELLS = 1 << 18


def gapless(df: DataFrame, group: str, key: str, out: str, groups: int, ties: tuple[str, ...] = (), cells: int = 4096) -> DataFrame:
    """Number the rows of each of at most ``groups`` groups 0, 1, ... without bringing a group together.

    Rows go to ``cells`` cells by the md5 of ``key``; a row's number is the rows of its
    group in earlier cells plus its rank (by key, then ``ties``) in its own cell. Only the
    cells' counts, at most ``cells`` a group, are summed in order; they are broadcast
    unless there are more than ``BROADCAST_CELLS``. Rows equal in key and ties are
    ordered arbitrarily among themselves.
    """
    width = max(1, math.ceil(math.log(cells, 16)))
    cell = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, width)
    keyed = df.withColumn("_cell", cell)
    counts = keyed.groupBy(F.col(group).alias("_g"), F.col("_cell").alias("_c")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_g", "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    if groups * 16**width <= BROADCAST_CELLS:
        starts = F.broadcast(starts)
    rank = F.row_number().over(W.partitionBy(group, "_cell").orderBy(F.col(key).asc_nulls_first(), *ties)) - 1
    ranked = keyed.withColumn("_rank", rank)
    joined = ranked.join(starts, ranked[group].eqNullSafe(F.col("_g")) & (ranked["_cell"] == F.col("_c")))
    return joined.withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_cell", "_rank", "_before", "_g", "_c")


def add_up(parts: DataFrame, block: str, payload: str, dtype: str, combine: str, spread: int) -> dict[int, np.ndarray]:
    """Combine equally long binary vectors by ``block`` in two steps and bring them to the driver.

    ``parts`` has one row per block and task, so a block's rows grow with the input:
    they are first combined in ``spread`` salted groups. What reaches the driver is one
    vector per block, a size fixed by the caller.
    """
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("payload").to_pylist():
            vector = np.frombuffer(raw, dtype)
            total = vector.copy() if total is None else (total | vector if combine == "or" else total + vector)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})

    rows = parts.select(F.col(block).cast("int").alias("block"), F.col(payload).alias("payload"))
    first = rows.groupBy("block", F.pmod(F.xxhash64(F.rand(7)), F.lit(spread)).alias("salt")).applyInArrow(merge, schema)
    with small_batches(parts.sparkSession):
        return {r.block: np.frombuffer(r.payload, dtype) for r in first.groupBy("block").applyInArrow(merge, schema).collect()}


def components(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """(node, component): connected components of the edges (u, v), named by their least node.

    Alternates the large-star and small-star steps until the edges form stars; each
    round is written to the shared folder. Nodes without edges do not appear.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/edges0")
    step = 0
    while True:
        step += 1
        roots = now.select(F.col("u").alias("x")).distinct()
        if now.join(roots, now.v == roots.x, "left_semi").isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            break
        if step > 200:  # the number of rounds grows with the logarithm of the nodes
            raise RuntimeError("connected components have not settled")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = store(small, f"{path}/edges{step}")
        remove(spark, f"{path}/edges{step - 1}")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
