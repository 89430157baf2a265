"""Scoring payloads: nested JSON to flat, validated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.functions.constants import MAX_KNOWN_MERCHANTS, MAX_U32
from nearvote.functions.moments import minutes_between, parse_iso

SCHEMA = """
    id string,
    transaction struct<amount: double, installments: double, requested_at: string>,
    customer struct<avg_amount: double, tx_count_24h: double, known_merchants: array<string>>,
    merchant struct<id: string, mcc: string, avg_amount: double>,
    terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>,
    last_transaction struct<timestamp: string, km_from_current: double>,
    _corrupt string
"""

#: The reasons for which a payload is refused, in the order in which they are tried.
REASONS = ["malformed", "installments", "tx_count_24h", "known_merchants", "mcc", "requested_at", "last_transaction"]


def reason(p: Column) -> Column:
    """Why a parsed payload is refused, null if it is valid. Absent fields are zero and valid, but for requested_at."""
    last = p["last_transaction"]
    now, then = parse_iso(p["transaction"]["requested_at"]), parse_iso(last["timestamp"])
    outside = lambda x, most: F.isnan(x) | (x < 0) | (x > most)
    tests = [
        p.isNull() | p["_corrupt"].isNotNull(),
        F.coalesce(outside(p["transaction"]["installments"], 255), F.lit(False)),
        F.coalesce(outside(p["customer"]["tx_count_24h"], MAX_U32), F.lit(False)),
        F.coalesce(F.size(p["customer"]["known_merchants"]) > MAX_KNOWN_MERCHANTS, F.lit(False)),
        F.coalesce(~p["merchant"]["mcc"].rlike("^[0-9]*$") | (F.length(p["merchant"]["mcc"]) > 18), F.lit(False)),
        now.isNull(),
        last.isNotNull() & (then.isNull() | last["km_from_current"].isNull()),
    ]
    out = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        out = F.when(test, name).otherwise(out)
    return out


def parse_payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """df with payload (parsed) and reason (null if valid)."""
    parsed = F.from_json(F.col(body), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("payload", parsed)
    return out.withColumn("reason", reason(F.col("payload")))


def flatten(df: DataFrame, *keep: str) -> DataFrame:
    """keep and the flat columns of valid payloads; absent numbers and texts are zero and empty."""
    c = F.col
    last = c("payload.last_transaction")
    now = parse_iso(c("payload.transaction.requested_at"))
    zero = lambda x, kind: F.coalesce(x, F.lit(0)).cast(kind)
    mcc = F.coalesce(F.nullif(c("payload.merchant.mcc"), F.lit("")).try_cast("bigint"), F.lit(0))
    return df.where(c("reason").isNull()).select(
        *keep,
        zero(c("payload.transaction.amount"), "float").alias("amount"),
        zero(c("payload.transaction.installments"), "int").alias("installments"),
        now.alias("requested_at"),
        zero(c("payload.customer.avg_amount"), "float").alias("cust_avg_amount"),
        zero(c("payload.customer.tx_count_24h"), "bigint").alias("tx_count_24h"),
        F.coalesce(c("payload.customer.known_merchants"), F.array().cast("array<string>")).alias("known_merchants"),
        F.coalesce(c("payload.merchant.id"), F.lit("")).alias("merchant_id"),
        F.when(mcc > 2_000_000_000, -1).otherwise(mcc).cast("int").alias("mcc"),
        zero(c("payload.merchant.avg_amount"), "float").alias("merchant_avg_amount"),
        F.coalesce(c("payload.terminal.is_online"), F.lit(False)).alias("is_online"),
        F.coalesce(c("payload.terminal.card_present"), F.lit(False)).alias("card_present"),
        zero(c("payload.terminal.km_from_home"), "float").alias("km_from_home"),
        F.when(last.isNotNull(), minutes_between(now, parse_iso(last["timestamp"]))).alias("last_minutes"),
        last["km_from_current"].cast("float").alias("last_km"),
    )
