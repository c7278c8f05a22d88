"""Index folders: Parquet tables and a description of what they hold.

An inverted file has two tables of vectors. ``lists`` holds them as 16-bit fixed point, packed
by cluster and in cluster order, so that a scan for few clusters skips row groups and a
routed search shuffles few rows. ``exact`` is its companion: the floats, in order of their ids,
which may lie in another folder and are read only to rerank candidates. ``clusters`` and
``profile`` are small.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.config import SCALE, ScoringConfig
from nearvote.functions.vector import quantize
from nearvote.operators import ivf, kmeans, kmknn, knn, routed
from nearvote.operators.index import cluster_stats, profile_table
from nearvote.sources.scratch import stored

FORMATS = {"exact": 1, "ivf": 10, "kmknn": 5}


@dataclass(frozen=True)
class Meta:
    format: str
    version: int
    dims: int
    scale: int = SCALE
    k: int = 0
    nprobe: int = 5
    rows: int = 0


@dataclass(frozen=True)
class Index:
    """An opened index: a detector for (qid, qv) rows."""

    meta: Meta
    #: (ref_id, vec, fraud) floats: all that an exact index has, else the companion, if there is one.
    exact: DataFrame | None
    #: (cluster_id, part, ids, marks, q) fixed point.
    lists: DataFrame | None = None
    clusters: DataFrame | None = None
    profile: DataFrame | None = None

    def score(self, queries: DataFrame, config: ScoringConfig | None = None, exclude_self: bool = False, stats: ivf.SearchStats | None = None) -> DataFrame:
        """(qid, fraud_count, path, approved, fraud_score) by the index's own method; an
        inverted file fills ``stats``."""
        config = config or ScoringConfig(nprobe=self.meta.nprobe)
        if self.meta.format == "exact":
            found = knn.nearest(queries, self.exact, config.neighbours, self.meta.dims, config, exclude_self)
            return knn.vote(found, config.neighbours).withColumn("path", F.lit("exact"))
        if self.meta.format == "kmknn":
            return kmknn.score(queries, self.lists, self.clusters, self.meta.dims, config, exclude_self)
        if self.exact is None and config.rerank:
            raise ValueError("reranking needs the index's companion of exact vectors")
        return ivf.score(queries, self.exact, self.lists, self.clusters, self.meta.dims, config, self.profile, exclude_self, stats)

    def warm(self) -> int:
        """Keep the scanned vectors in memory until ``release``; returns their number."""
        if self.lists is None:
            return self.exact.persist().count()
        return self.lists.persist().agg(F.sum(F.size("ids"))).first()[0]

    def release(self) -> None:
        (self.exact if self.lists is None else self.lists).unpersist()


def write_index(references: DataFrame, path: str, kind: str, dims: int, k: int = 4096, iterations: int = 20, nprobe: int = 5, files: int = 16, exact: str | None = None, state: str | None = None) -> None:
    """Build and write an index of ``references`` (ref_id, vec, fraud).

    ``exact``: the folder of an inverted file's companion, by default inside ``path``. ``state``: a folder
    in which the clustering keeps its rounds, so that a build that was stopped goes on there.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown index format {kind!r}; known: {', '.join(FORMATS)}")
    spark = references.sparkSession
    references = references.select("ref_id", "vec", "fraud")
    by_id = references.repartitionByRange(files, "ref_id").sortWithinPartitions("ref_id")
    if kind == "exact":
        by_id.write.mode("overwrite").parquet(f"{path}/exact")
        rows = spark.read.parquet(f"{path}/exact").count()
    else:
        centroids, assigned = kmeans.fit(references, k, dims, iterations, state)
        assigned = stored(assigned)
        rows = assigned.count()
        members = assigned.select("d", "ref_id", F.col("fraud").alias("mark"), "cluster_id", quantize(F.col("vec")).cast("array<smallint>").alias("q"))
        routed.inverted_lists(members).repartitionByRange(files, "cluster_id").sortWithinPartitions("cluster_id", "part").write.mode("overwrite").parquet(f"{path}/lists")
        cluster_stats(assigned, centroids, dims).where("cnt > 0").write.mode("overwrite").parquet(f"{path}/clusters")
        if kind == "ivf":
            by_id.write.mode("overwrite").parquet(exact or f"{path}/exact")
            if dims == 14:
                profile_table(references).write.mode("overwrite").parquet(f"{path}/profile")
    meta = Meta(kind, FORMATS[kind], dims, k=0 if kind == "exact" else k, nprobe=nprobe, rows=rows)
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def open_index(spark: SparkSession, path: str, exact: str | None = None) -> Index:
    """The index in a folder. An unknown format or version is an error, and so is a companion of
    exact vectors (by default in the same folder) with another number of rows or dimensions."""
    meta = Meta(**json.loads(spark.read.text(f"{path}/meta").first()["value"]))
    if FORMATS.get(meta.format) != meta.version:
        raise ValueError(f"{path}: format {meta.format} version {meta.version} is not supported")
    floats = None if meta.format == "kmknn" else spark.read.parquet(exact or f"{path}/exact")
    if floats is not None:
        rows, first = floats.count(), floats.select(F.size("vec")).first()
        if rows != meta.rows or first is not None and first[0] != meta.dims:
            raise ValueError(f"{path}: the index has {meta.rows} vectors of {meta.dims} dimensions, {exact or 'its exact table'} {rows} of {first and first[0]}")
    if meta.format == "exact":
        return Index(meta, floats)
    lists = spark.read.parquet(f"{path}/lists")
    profile = spark.read.parquet(f"{path}/profile") if meta.format == "ivf" and meta.dims == 14 else None
    return Index(meta, floats, lists, spark.read.parquet(f"{path}/clusters"), profile)
