"""Cutting lineage with a table in a folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written so far, by application.
_written: dict[str, list[str]] = {}
#: Tables that a thread deletes when it leaves `passing`.
_passing = threading.local()
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, on a local master only, under a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("nearvote.shared", spark.conf.get("nearvote.shared", None) or tempfile.mkdtemp(prefix="nearvote-"))
        folder = spark.conf.get("nearvote.shared")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df as a table; what was shuffled to make it is deleted."""
    path = shared_path(df.sparkSession, what)
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    held = getattr(_passing, "paths", None)
    (_written.setdefault(df.sparkSession.sparkContext.applicationId, []) if held is None else held).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that `materialise` wrote for this application; for when no result made from them is used any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that this thread wrote within it; for work without end, such as micro-batches."""
    before, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, before
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
