"""Routing and header parsing of scoring requests, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import MAX_BODY

READY, SCORE = "/ready", "/fraud-score"


def same_ascii(a: Column, b: str) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.lit(b.lower())


def parse_request(raw: Column) -> Column:
    """struct(state, method, path, content_length, keepalive, body); state: ok, more or bad."""
    end = F.instr(raw, "\r\n\r\n")
    head = F.substring(raw, F.lit(1), end - 1)
    lines = F.split(head, "\r\n", -1)
    words = F.split(F.get(lines, F.lit(0)), " ", -1)
    headers = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(headers, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.ltrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    lengths = F.transform(F.filter(pairs, lambda p: same_ascii(p["name"], "content-length")), lambda p: p["value"])
    wrong = F.exists(lengths, lambda v: ~v.rlike("^[0-9]+$") | (F.coalesce(v.try_cast("bigint"), F.lit(MAX_BODY + 1)) > MAX_BODY))
    length = F.coalesce(F.element_at(F.filter(F.transform(lengths, lambda v: v.try_cast("bigint")), lambda v: v.isNotNull()), -1), F.lit(0).cast("bigint"))
    length = F.when(F.size(lengths) > 0, length).otherwise(F.lit(0).cast("bigint"))
    closing = F.exists(pairs, lambda p: same_ascii(p["name"], "connection") & same_ascii(p["value"], "close"))
    body = F.substring(raw, end + 4, F.length(raw))
    state = F.when(end == 0, "more").when((F.size(words) < 3) | wrong, "bad").when(F.length(body) < length, "more").otherwise("ok")
    ok = state == "ok"
    return F.struct(
        state.alias("state"),
        F.when(ok, F.when(F.get(words, F.lit(0)).isin("GET", "POST"), F.get(words, F.lit(0))).otherwise("OTHER")).alias("method"),
        F.when(ok, F.get(words, F.lit(1))).alias("path"),
        F.when(ok, length).alias("content_length"),
        F.when(ok, ~closing).alias("keepalive"),
        F.when(ok, F.substring(body, F.lit(1), length.cast("int"))).alias("body"),
    )


def route(method: Column, path: Column) -> Column:
    return F.when((method == "GET") & (path == READY), "ready").when((method == "POST") & (path == SCORE), "score").otherwise("not_found")


def status(method: Column, path: Column) -> Column:
    return F.when(route(method, path) == "not_found", 404).otherwise(200)
