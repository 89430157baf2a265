"""Nearest rows for each query under the total order (distance, identifier)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearvote.functions.constants import K


def top_k(pairs: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The k rows with the smallest (dist, orig_id) for each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy("dist", "orig_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gathered(top: DataFrame, keys: list[str]) -> DataFrame:
    """keys and top: the ranked rows as array<struct<dist, orig_id, label>>; at most k for each key."""
    item = F.struct("dist", "orig_id", F.col("is_fraud").cast("int").alias("label"))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("top"))


def votes(top: Column) -> Column:
    """Labels of fraud among the neighbours; empty places count as none."""
    return F.coalesce(F.aggregate(top, F.lit(0), lambda n, x: n + x["label"]), F.lit(0))
