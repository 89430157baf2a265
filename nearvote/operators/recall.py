"""How well the budgeted search does against the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearvote.functions.constants import DECLINE_FROM, K

from .topk import gathered, votes


def compared(exact: DataFrame, searched: DataFrame) -> DataFrame:
    """qid, overlap, exact_count, fraud_count, visited; exact: ranked neighbours, or qid and top; searched: results of a search."""
    exact = exact if "top" in exact.columns else gathered(exact, ["qid"])
    ids = exact.select("qid", F.transform("top", lambda x: x["orig_id"]).alias("ids"), votes(F.col("top")).alias("exact_count"))
    both = ids.join(searched, "qid")
    overlap = F.size(F.array_intersect("ids", F.transform("top", lambda x: x["orig_id"])))
    return both.select("qid", overlap.alias("overlap"), "exact_count", "fraud_count", "visited")


def percentiles(values: DataFrame, column: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """One row: for each name the value at place n * numerator / denominator of the sorted column, counted from 0; null if there is none.

    Values are counted first; only the different ones, here at most a cluster count, are sorted.
    """
    counted = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("x"))
    ranked = counted.withColumn("upto", upto).crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total"))))
    return ranked.agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("total") * a / b), F.col("x"))).alias(name) for name, (a, b) in places.items()))


def report(both: DataFrame, label: str) -> DataFrame:
    """One row of quality figures."""
    sums = both.agg(
        F.count("*").alias("n_queries"),
        (F.sum("overlap") / (F.count("*") * K)).alias("recall"),
        F.avg((F.col("exact_count") == F.col("fraud_count")).cast("int")).alias("match_rate"),
        F.avg(((F.col("exact_count") < DECLINE_FROM) != (F.col("fraud_count") < DECLINE_FROM)).cast("int")).alias("flip_rate"),
        F.avg("visited").alias("mean_visited"),
        F.max("visited").alias("max_visited"),
    )
    at = percentiles(both, "visited", {"p50": (1, 2), "p99": (99, 100), "p999": (999, 1000)})
    figures = ["n_queries", "recall", "match_rate", "flip_rate", "mean_visited", "p50", "p99", "p999", "max_visited"]
    return sums.crossJoin(F.broadcast(at)).select(F.lit(label).alias("config"), *figures)
