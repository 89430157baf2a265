"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the folder all
machines share and read again as the next one's docs, so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import decontaminate, exact_dedup, order_minhash, packing, quality, toxicity
from nearvote.llm.common import cut, table
from nearvote.llm.queries import tokenizer_path

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted to the labels, scores at TOXIC_FROM or more go."""
    allowed = quality.remainder(F.col("doc_id"), 3) != 1
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), allowed), TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest identifier stays."""
    return order_minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row, or all words, of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left and their places in sequences of 2048."""
    return packing.pack(docs, tokenizer_path(), length=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity, near-duplicates and packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
