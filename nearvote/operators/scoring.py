"""From votes to decisions and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.functions.constants import DECLINE_FROM, K

from .topk import gathered, votes


def fraud_score(count: Column) -> Column:
    return count.cast("double") / F.lit(float(K))


def approved(count: Column) -> Column:
    return count < DECLINE_FROM


def decide(found: DataFrame) -> DataFrame:
    """qid, fraud_count, fraud_score, approved from ranked neighbours."""
    voted = gathered(found, ["qid"]).select("qid", votes(F.col("top")).alias("fraud_count"))
    return voted.select("qid", "fraud_count", fraud_score(F.col("fraud_count")).alias("fraud_score"), approved(F.col("fraud_count")).alias("approved"))


def response_body(count: Column) -> Column:
    return F.to_json(F.struct(approved(count).alias("approved"), fraud_score(count).alias("fraud_score")))
