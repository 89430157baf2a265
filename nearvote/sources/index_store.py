"""The search index as Parquet tables: meta, clusters, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearvote.functions.constants import SCALE

VERSION = 2


def save_index(clusters: DataFrame, vectors: DataFrame, path: str, dim: int, n_parts: int | None = None) -> None:
    """vectors are dealt and sorted by cluster, so that row groups can be skipped by cluster_id."""
    spark = clusters.sparkSession
    dealt = vectors.repartitionByRange(n_parts, "cluster_id") if n_parts else vectors.repartitionByRange("cluster_id")
    dealt.sortWithinPartitions("cluster_id", "orig_id").write.mode("overwrite").parquet(f"{path}/vectors")
    clusters.coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
    n = spark.read.parquet(f"{path}/vectors").count()
    meta = f"SELECT {VERSION} AS version, {n}L AS n_vectors, {dim} AS dim, {clusters.count()} AS nlist, {SCALE} AS scale"
    spark.sql(meta).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, vectors); ValueError if the tables are of another version, shape or size."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None:
        raise ValueError("the index has no meta row")
    if meta["version"] != VERSION:
        raise ValueError(f"index version {meta['version']}, not {VERSION}")
    if meta["dim"] != dim:
        raise ValueError(f"index of {meta['dim']} dimensions, not {dim}")
    clusters, vectors = spark.read.parquet(f"{path}/clusters"), spark.read.parquet(f"{path}/vectors")
    if clusters.count() != meta["nlist"] or vectors.count() != meta["n_vectors"]:
        raise ValueError("the index is not complete")
    return clusters, vectors


def prewarmed(clusters: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables, cached on the executors and read once, so that the first request finds them there."""
    out = clusters.persist(), vectors.persist()
    for df in out:
        df.count()
    return out


def ready(clusters: DataFrame, vectors: DataFrame) -> bool:
    """Whether both tables are cached, which is when requests may be sent."""
    return all(df.storageLevel.useMemory and df.is_cached for df in (clusters, vectors))
