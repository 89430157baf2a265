"""Scoring an unbounded stream of payloads against a static index, micro-batch by micro-batch.

Requests are independent of one another, so no state and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearvote.functions.constants import DIM, FAST, FULL
from nearvote.functions.features import build_vectors
from nearvote.operators.ivf import search
from nearvote.operators.lineage import materialise, passing
from nearvote.operators.scoring import response_body
from nearvote.sources.payloads import flatten, parse_payloads


def score_batch(requests: DataFrame, clusters: DataFrame, vectors: DataFrame, fast: int = FAST, full: int = FULL) -> DataFrame:
    """id, status, body for requests (id, body): 200 and the decision, or 400 and nothing."""
    parsed = parse_payloads(requests)
    queries = materialise(build_vectors(flatten(parsed, F.col("id").alias("orig_id")), "orig_id"), "queries")  # they are parsed once
    scored = search(queries, clusters, vectors, DIM, fast, full).select(F.col("qid").alias("id"), F.lit(200).alias("status"), response_body(F.col("fraud_count")).alias("body"))
    refused = parsed.where(F.col("reason").isNotNull()).select("id", F.lit(400).alias("status"), F.lit(None).cast("string").alias("body"))
    return scored.unionByName(refused)


def read_requests(spark: SparkSession, source: str, options: dict[str, str], id_col: Column, body_col: Column) -> DataFrame:
    """A stream (id, body) from any source of Structured Streaming, such as kafka (its key and value), socket or rate."""
    rows = spark.readStream.format(source).options(**options).load()
    return rows.select(id_col.cast("bigint").alias("id"), body_col.cast("string").alias("body"))


def score_stream(requests: DataFrame, sink: str, checkpoint: str, clusters: DataFrame, vectors: DataFrame, fast: int = FAST, full: int = FULL, available_now: bool = True) -> StreamingQuery:
    """Writes the answers to a stream (id, body) as Parquet, one folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            score_batch(batch, clusters, vectors, fast, full).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str, clusters: DataFrame, vectors: DataFrame, fast: int = FAST, full: int = FULL, files_per_trigger: int = 16, available_now: bool = True) -> StreamingQuery:
    """Scores JSON lines (id, body) from a folder."""
    requests = spark.readStream.schema("id bigint, body string").option("maxFilesPerTrigger", files_per_trigger).json(source)
    return score_stream(requests, sink, checkpoint, clusters, vectors, fast, full, available_now)
