"""Scalar functions: fixed examples and a single-precision emulation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote.functions.constants import MCC_RISK
from nearvote.functions.features import mcc_risk
from nearvote.functions.moments import minutes_between, parse_iso
from nearvote.functions.numeric import clamp01, dequantise, f32, quantise, quantise_sql, ratio, scaled
from nearvote.functions.requests import parse_request, route, status


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_clamp(spark):
    assert one(spark, *(clamp01(f32(x)) for x in (-0.5, 1.5, 0.5))) == (0.0, 1.0, 0.5)


def test_quantise_rounds_half_away_and_saturates(spark):
    cases = {0.00005: 1, -0.00005: -1, 0.00025: 3, 9.0: 32767, -9.0: -32768, float("nan"): 0, float("inf"): 0, float("-inf"): 0, 1.0: 10000}
    assert one(spark, *(quantise(f32(x)) for x in cases)) == tuple(cases.values())


def test_quantise_is_exact_at_halves_without_decimals(spark):
    rows = spark.range(200_001).select(((F.col("id") - 100_000) / 2).cast("float").alias("y"))
    x = (F.col("y") / 10_000).cast("float")
    exact = F.round(F.greatest(F.lit(-32768.0).cast("float"), F.least(F.lit(32767.0).cast("float"), x * F.lit(10_000.0).cast("float")))).cast("smallint")
    both = rows.select(quantise(x).alias("got"), exact.alias("exact"), F.expr(quantise_sql("cast(y / 10000 as float)")).alias("sql"))
    assert both.where("got <> exact OR sql <> exact OR got IS NULL").count() == 0
    assert "round(" not in rows.select(quantise(x))._jdf.queryExecution().optimizedPlan().toString()


def test_quantised_amounts_match_single_precision(spark):
    amounts = [i / 100 for i in range(0, 200_000, 37)]
    rows = spark.createDataFrame([(a,) for a in amounts], "a double").select("a", quantise(clamp01(scaled(F.col("a"), 10_000.0))).alias("q")).collect()
    for a, q in rows:
        x = np.float32(a) * np.float32(1 / 10_000)
        y = np.float32(min(max(x, np.float32(0)), np.float32(1))) * np.float32(10_000)
        assert q == int(np.floor(np.float64(y) + 0.5))


def test_dequantise_and_ratio(spark):
    assert one(spark, dequantise(F.lit(10_000).cast("smallint")))[0] == pytest.approx(1.0)
    assert one(spark, ratio(f32(3.0), f32(2.0)), ratio(f32(3.0), f32(0.0)), ratio(f32(3.0), f32(-1.0))) == (1.5, 0.0, 0.0)


def test_moments(spark):
    moments = [dt.datetime(1970, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59), dt.datetime(2000, 2, 29, 7, 8, 9), dt.datetime(2032, 11, 30, 16, 45), dt.datetime(2100, 3, 1, 4)]
    for k, want in enumerate(moments):
        ts = parse_iso(F.lit(want.isoformat() + "Z" + " rest" * (k % 2)))
        assert one(spark, F.hour(ts), F.weekday(ts), ts) == (want.hour, want.weekday(), want)
    for bad in ("2031-04-31T00:00:00Z", "2031-01-01T24:30:00Z", "2031-01-01T00:00:00", "", "2031-01-01 00:00:00Z"):
        assert one(spark, parse_iso(F.lit(bad))) == (None,)


def test_minutes(spark):
    a, b = parse_iso(F.lit("2033-05-06T08:00:30Z")), parse_iso(F.lit("2033-05-06T07:00:00Z"))
    assert one(spark, minutes_between(a, b), minutes_between(b, a)) == (60.5, -60.5)


def test_mcc(spark):
    assert one(spark, *(mcc_risk(F.lit(m)) for m in MCC_RISK)) == pytest.approx(tuple(MCC_RISK.values()))
    assert one(spark, mcc_risk(F.lit(1)), mcc_risk(F.lit(None))) == (0.5, 0.5)


def test_requests(spark):
    cases = {
        "GET /ready HTTP/1.1\r\nHost: x\r\n\r\n": ("ok", "GET", "/ready", 0, True, ""),
        "POST /fraud-score HTTP/1.1\r\ncontent-LENGTH:   5\r\n\r\nhello tail": ("ok", "POST", "/fraud-score", 5, True, "hello"),
        "POST /fraud-score HTTP/1.1\r\nContent-Length: 5\r\n\r\nhel": ("more",) + (None,) * 5,
        "GET /ready HTTP/1.1\r\nHost: x\r\n": ("more",) + (None,) * 5,
        "GET /ready HTTP/1.1\r\nConnection: close\r\n\r\n": ("ok", "GET", "/ready", 0, False, ""),
        "GET / HTTP/1.1\r\nContent-Length: 999999999\r\n\r\n": ("bad",) + (None,) * 5,
        "GET / HTTP/1.1\r\nContent-Length: x\r\n\r\n": ("bad",) + (None,) * 5,
        "GET /\r\n\r\n": ("bad",) + (None,) * 5,
        "PUT /x HTTP/1.1\r\nno header\r\n\r\n": ("ok", "OTHER", "/x", 0, True, ""),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, raw string").select("i", F.inline(F.array(parse_request(F.col("raw"))))).collect()
    assert {tuple(r)[0]: tuple(r)[1:] for r in rows} == dict(enumerate(cases.values()))


def test_routes(spark):
    for method, path, want, code in (("GET", "/ready", "ready", 200), ("POST", "/fraud-score", "score", 200), ("POST", "/ready", "not_found", 404), ("POST", "/fraud-score?x", "not_found", 404)):
        assert one(spark, route(F.lit(method), F.lit(path)), status(F.lit(method), F.lit(path))) == (want, code)
