"""Payload validation, the reference reader, the index store."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from nearvote.functions.constants import MCC_RISK
from nearvote.functions.features import build_vectors
from nearvote.sources.index_store import load_index, prewarmed, ready, save_index
from nearvote.sources.payloads import flatten, parse_payloads
from nearvote.sources.references import quantised, read_references

GOOD = {
    "id": "pay-0042",
    "transaction": {"amount": 1729.04, "installments": 7, "requested_at": "2031-03-08T05:06:07Z"},
    "customer": {"avg_amount": 88.5, "tx_count_24h": 11, "known_merchants": ["shop-7", "shop-19", "shop-31"]},
    "merchant": {"id": "shop-23", "mcc": "4511", "avg_amount": 940.75},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 301.25},
    "last_transaction": {"timestamp": "2031-03-07T21:00:00Z", "km_from_current": 77.5},
}


def changed(section, **fields):
    return {**GOOD, section: {**(GOOD[section] or {}), **fields}}


def without(section, field):
    return {**GOOD, section: {k: v for k, v in GOOD[section].items() if k != field}}


CASES = [
    (json.dumps(GOOD), None),
    (json.dumps(GOOD) + " trailing", None),
    (json.dumps({**GOOD, "extra": {"a": [1, {"b": 2}]}}), None),
    (json.dumps({**GOOD, "last_transaction": None}), None),
    (json.dumps({"transaction": {"requested_at": "2031-03-08T05:06:07Z"}}), None),
    (json.dumps(changed("transaction", installments=-1)), "installments"),
    (json.dumps(changed("transaction", installments=256)), "installments"),
    (json.dumps(changed("customer", tx_count_24h=-1)), "tx_count_24h"),
    (json.dumps(changed("customer", known_merchants=[str(i) for i in range(33)])), "known_merchants"),
    (json.dumps(changed("merchant", mcc="59x2")), "mcc"),
    (json.dumps(without("transaction", "requested_at")), "requested_at"),
    (json.dumps(changed("transaction", requested_at="2031-03-08T05:06:07")), "requested_at"),
    (json.dumps(changed("transaction", requested_at="2031-02-29T05:06:07Z")), "requested_at"),
    (json.dumps(without("last_transaction", "timestamp")), "last_transaction"),
    (json.dumps(without("last_transaction", "km_from_current")), "last_transaction"),
    ("not json", "malformed"),
    (json.dumps(changed("transaction", amount="12")), "malformed"),
    (json.dumps(GOOD).replace("1729.04", "01729.04"), "malformed"),
    ("{}", "requested_at"),
    (None, "malformed"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, body) for i, (body, _) in enumerate(CASES)]
    return parse_payloads(spark.createDataFrame(rows, "n int, body string")).persist()


def test_reasons(parsed):
    assert {r["n"]: r["reason"] for r in parsed.select("n", "reason").collect()} == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_flat_values_and_vector(parsed):
    rows = {r["n"]: r for r in flatten(parsed, "n").collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    full, none, bare = rows[0], rows[3], rows[4]
    assert (full["installments"], full["mcc"], full["merchant_id"], full["tx_count_24h"]) == (7, 4511, "shop-23", 11)
    assert full["last_minutes"] == pytest.approx(8 * 60 + 6 + 7 / 60) and full["last_km"] == pytest.approx(77.5)
    assert none["last_minutes"] is None and none["last_km"] is None
    assert (bare["amount"], bare["mcc"], bare["merchant_id"], bare["known_merchants"], bare["is_online"]) == (0.0, 0, "", [], False)
    vectors = {r["n"]: r for r in build_vectors(flatten(parsed, "n"), "n").collect()}
    v = vectors[0]
    assert abs(v["v0"] - 1729) <= 2 and (v["v9"], v["v10"], v["v11"]) == (0, 10000, 10000) and v["v12"] == round(MCC_RISK[4511] * 10000)
    assert vectors[3]["v5"] == vectors[3]["v6"] == -10000
    assert vectors[4]["v12"] == 5000


def write(path, data: bytes):
    path.write_bytes(gzip.compress(data))
    return str(path)


def test_references(spark, tmp_path):
    vector = [round(0.01 * j, 2) for j in range(14)]
    records = [
        {"vector": vector, "label": "fraud"},
        {"vector": vector[:3], "label": "fraud"},
        {"vector": vector},
        {"label": "legit", "vector": vector},
        {"vector": [None, *vector[1:]], "label": "fraud"},
        {"vector": vector, "label": "anything"},
    ]
    refs = read_references(spark, write(tmp_path / "a.json.gz", json.dumps(records).encode()))
    assert [(r["orig_id"], r["is_fraud"]) for r in refs.orderBy("orig_id").collect()] == [(0, True), (1, False), (2, False)]
    assert [quantised(refs).first()[f"v{j}"] for j in range(14)] == [100 * j for j in range(14)]


@pytest.mark.parametrize("data", [b'[{"vector": [1.0], "lab', b"nothing"])
def test_broken_reference_files(spark, tmp_path, data):
    with pytest.raises(ValueError):
        read_references(spark, write(tmp_path / "b.json.gz", data))


def test_index_store(spark, tmp_path):
    vectors = spark.range(8).select((F.col("id") % 2).cast("int").alias("cluster_id"), F.col("id").alias("orig_id"), (F.col("id") > 3).alias("is_fraud"), F.col("id").cast("smallint").alias("v0"))
    clusters = spark.range(2).select(F.col("id").cast("int").alias("cluster_id"), F.lit(4).alias("n"))
    path = str(tmp_path / "index")
    save_index(clusters, vectors, path, 1)
    got_clusters, got = load_index(spark, path, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.collect())) and got_clusters.count() == 2
    warm_clusters, warm = prewarmed(*load_index(spark, path, 1))
    assert warm.is_cached and warm_clusters.is_cached and ready(warm_clusters, warm)
    warm.unpersist()
    assert not ready(warm_clusters, warm)
    warm_clusters.unpersist()
    with pytest.raises(ValueError):
        load_index(spark, path, 14)
    spark.sql("SELECT 1 AS version, 8L AS n_vectors, 1 AS dim, 2 AS nlist, 10000 AS scale").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError):
        load_index(spark, path, 1)
