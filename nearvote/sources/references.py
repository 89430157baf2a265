"""Labelled reference vectors from a (gzipped) JSON array of {"vector": [...], "label": "..."}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearvote.functions.constants import DIM
from nearvote.functions.numeric import quantise

SCHEMA = "vector array<float>, label string, _corrupt string"


def read_references(spark: SparkSession, path: str, dim: int = DIM) -> DataFrame:
    """orig_id, vector, is_fraud. Records without a label or with another number of values are left out.

    A root that isn't an array, or an array that breaks off, raises ValueError. A gzipped array can't be split, so it is
    read by one task; ids are dense in file order.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.persist()
    try:
        broken = raw.where(F.col("_corrupt").isNotNull() & F.col("vector").isNull() & F.col("label").isNull()).select("_corrupt").limit(1).collect()
        if broken and not _whole_array(broken[0][0]):
            raise ValueError("the file isn't a JSON array of records")
    finally:
        raw.unpersist()
    good = raw.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull()) & F.col("label").isNotNull())
    numbered = good.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    # dense over several files too: places within a partition plus the sizes of those before
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "first", before.alias("start"))
    return numbered.join(F.broadcast(starts), "part").select((F.col("start") + F.col("n") - F.col("first")).alias("orig_id"), "vector", (F.col("label") == "fraud").alias("is_fraud"))


def _whole_array(text: str | None) -> bool:
    text = (text or "").strip()
    return text.startswith("[") and text.endswith("]")


def quantised(refs: DataFrame, dim: int = DIM) -> DataFrame:
    """orig_id, v0..., is_fraud."""
    return refs.select("orig_id", *(quantise(F.col("vector")[j]).alias(f"v{j}") for j in range(dim)), "is_fraud")
