"""The 14 features of a transaction, as expressions over the flat payload columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import DAYS, DEFAULT_RISK, HOURS, MAX_AMOUNT, MAX_INSTALLMENTS, MAX_KM, MAX_MERCHANT_AVG, MAX_MINUTES, MAX_RATIO, MAX_TX_COUNT, MCC_RISK, MISSING
from .numeric import clamp01, f32, quantise, ratio, scaled


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[x for code, risk in MCC_RISK.items() for x in (F.lit(code), f32(risk))])
    return F.coalesce(F.try_element_at(table, mcc.cast("int")), f32(DEFAULT_RISK))


def amount_ratio(amount: Column, average: Column) -> Column:
    return scaled(ratio(amount, average), MAX_RATIO)


def unknown_merchant(merchant: Column, known: Column) -> Column:
    return ~F.coalesce(F.array_contains(known, merchant), F.lit(False))


def or_missing(x: Column, most: float) -> Column:
    return F.when(x.isNull(), F.lit(MISSING).cast("smallint")).otherwise(quantise(clamp01(scaled(x, most))))


def flag(x: Column) -> Column:
    return F.when(x, quantise(f32(1.0))).otherwise(quantise(f32(0.0)))


def feature_columns() -> list[Column]:
    c = F.col
    return [
        quantise(clamp01(scaled(c("amount"), MAX_AMOUNT))),
        quantise(clamp01(scaled(c("installments"), MAX_INSTALLMENTS))),
        quantise(clamp01(amount_ratio(c("amount"), c("cust_avg_amount")))),
        quantise(scaled(F.hour("requested_at"), HOURS)),
        quantise(scaled(F.weekday("requested_at"), DAYS)),
        or_missing(c("last_minutes"), MAX_MINUTES),
        or_missing(c("last_km"), MAX_KM),
        quantise(clamp01(scaled(c("km_from_home"), MAX_KM))),
        quantise(clamp01(scaled(c("tx_count_24h"), MAX_TX_COUNT))),
        flag(c("is_online")),
        flag(c("card_present")),
        flag(unknown_merchant(c("merchant_id"), c("known_merchants"))),
        quantise(mcc_risk(c("mcc"))),
        quantise(clamp01(scaled(c("merchant_avg_amount"), MAX_MERCHANT_AVG))),
    ]


def build_vectors(payloads: DataFrame, *keep: str) -> DataFrame:
    """keep and v0..v13 for each row of flat payloads."""
    return payloads.select(*keep, *(x.alias(f"v{j}") for j, x in enumerate(feature_columns())))
