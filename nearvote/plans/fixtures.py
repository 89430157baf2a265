"""Payloads, vectors and an index derived from the driver's tables `events` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearvote.functions.constants import DIM
from nearvote.functions.features import build_vectors
from nearvote.functions.moments import format_iso, minutes_between
from nearvote.functions.numeric import quantise_sql
from nearvote.operators import kmeans
from nearvote.operators.ivf import clusters_of
from nearvote.operators.lineage import materialise

# Category codes of the derived payloads, two of them unknown to the risk table.
MCC_CODES = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "1234", "0000"]
NLIST14, NLIST64, DIM64 = 32, 16, 64
ROUNDS = 3
#: Budgets that bind with so few clusters.
FAST, FULL = 2, 6
#: Clusters with which the operator's own budgets bind, and draws of the sampled report.
MANY14, SAMPLE = 256, 200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload for each event, in double precision, with the label is_fraud."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    derived = {"cents": F.round(F.col("value") * 100).cast("bigint"), "merchant_id": F.concat(F.lit("MERC-"), F.lpad((F.col("k") % 20).cast("string"), 3, "0"))}
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # merchants are twenty by definition, so their sums are merged from partial ones and sent to the rows
    merchants = raw.withColumns(derived).groupBy("merchant_id").agg(F.sum("cents").alias("m_sum"), F.count("*").alias("m_n"))
    merchants = merchants.select("merchant_id", (F.col("m_sum").cast("double") / F.col("m_n").cast("double") / F.lit(100.0) * F.lit(20.0)).alias("merchant_avg_amount"))
    past = F.sum("cents").over(before).cast("double") / F.nullif(F.count("*").over(before).cast("double"), F.lit(0.0)) / F.lit(100.0) * F.lit(20.0)
    day = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW)")
    raw = raw.repartition("user_id").withColumns(derived)  # what is derived isn't shuffled
    rows = raw.select(
        F.col("event_id").alias("id"),
        (F.col("value") * 20).alias("amount"),
        (F.lit(1) + F.col("event_id") % 15).cast("int").alias("installments"),
        F.col("ts").alias("requested_at"),
        F.coalesce(past, F.lit(0.0)).alias("cust_avg_amount"),
        (4 * (day - 1)).alias("tx_count_24h"),
        F.collect_list("merchant_id").over(order.rowsBetween(-5, -1)).alias("known_merchants"),
        "merchant_id",
        F.element_at(F.lit(MCC_CODES), F.col("k") % 12 + 1).alias("mcc"),
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("event_id") * 37 % 150000 / F.lit(100.0)).alias("km_from_home"),
        F.lag("ts").over(order).alias("last_ts"),
        (F.col("event_id") * 53 % 120000 / F.lit(100.0)).alias("km_from_current"),
        ((F.col("event_type") == "error") | (F.col("value") * 20 >= 2400)).alias("is_fraud"),
    )
    return rows.join(F.broadcast(merchants), "merchant_id")


def flat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat columns that `sources.payloads.flatten` gives, and is_fraud."""
    c = F.col
    return payload_rows(spark, sf_dir).select(
        "id", c("amount").cast("float").alias("amount"), "installments", F.date_trunc("second", "requested_at").cast("timestamp_ntz").alias("requested_at"),
        c("cust_avg_amount").cast("float").alias("cust_avg_amount"), "tx_count_24h", "known_merchants", "merchant_id", c("mcc").cast("int").alias("mcc"),
        c("merchant_avg_amount").cast("float").alias("merchant_avg_amount"), "is_online", "card_present", c("km_from_home").cast("float").alias("km_from_home"),
        minutes_between(c("requested_at"), c("last_ts")).alias("last_minutes"), F.when(c("last_ts").isNotNull(), c("km_from_current")).cast("float").alias("last_km"), "is_fraud",
    )


def body(fault: Column | None = None) -> Column:
    """The JSON text of a payload row; fault: a number from 1 to 7 for one of the ways to be refused."""
    c, ok = F.col, F.lit(0) if fault is None else fault
    if_ = lambda n, bad, good: F.when(ok == n, bad).otherwise(good)
    iso = format_iso(c("requested_at"))
    last = F.when(c("last_ts").isNotNull(), F.struct(format_iso(c("last_ts")).alias("timestamp"), c("km_from_current").alias("km_from_current")))
    many = F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: i.cast("string"))
    text = F.to_json(F.struct(
        c("id").cast("string").alias("id"),
        F.struct("amount", if_(1, F.lit(-1), c("installments")).alias("installments"), if_(5, F.rtrim(F.replace(iso, F.lit("Z"), F.lit(" "))), iso).alias("requested_at")).alias("transaction"),
        F.struct(c("cust_avg_amount").alias("avg_amount"), if_(2, F.lit(-1).cast("bigint"), c("tx_count_24h")).alias("tx_count_24h"), if_(3, many, c("known_merchants")).alias("known_merchants")).alias("customer"),
        F.struct(c("merchant_id").alias("id"), if_(4, F.lit("59x2"), c("mcc")).alias("mcc"), c("merchant_avg_amount").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        if_(6, F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit(None).cast("double").alias("km_from_current")), last).alias("last_transaction"),
    ))
    return if_(7, F.lit("not json"), text)


# Results that many queries share are written once for each session and state of the input's files.
_made: dict[tuple, object] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files; another state if the table is written anew."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, what, _state(spark, f"{sf_dir}/events.parquet"))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def vec14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orig_id, is_fraud, v0..v13"""
    make = lambda: materialise(build_vectors(flat_payloads(spark, sf_dir), F.col("id").alias("orig_id"), "is_fraud"), "vec14")
    return _once(spark, sf_dir, "vec14", make)


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orig_id, is_fraud, v0..v63"""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.selectExpr("vec_id AS orig_id", "label % 2 = 1 AS is_fraud", *(f"{quantise_sql(f'get(embedding, {j})')} AS v{j}" for j in range(DIM64)))


# Queries are the rows whose identifier is divisible by 20, at every size; they search all rows, themselves included.


def queries14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec14(spark, sf_dir).where(F.col("orig_id") % 20 == 0)


def queries64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec64(spark, sf_dir).where(F.col("orig_id") % 20 == 0)


def sampled14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAMPLE rows drawn with replacement by a fixed formula, numbered by draw; a row drawn twice is two queries."""
    rows = vec14(spark, sf_dir)
    first = rows.agg(F.min("orig_id").alias("first"), F.count("*").alias("n"))
    draws = spark.range(SAMPLE).crossJoin(F.broadcast(first)).select(F.col("id").alias("draw"), (F.col("first") + F.expr("(id * id * 31 + id * 7) % n")).alias("orig_id"))
    return rows.join(F.broadcast(draws), "orig_id").drop("orig_id").withColumnRenamed("draw", "orig_id")


def index14(spark: SparkSession, sf_dir: str, n_clusters: int = NLIST14, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(clusters, vectors with cluster_id) after so many rounds of integer k-means."""

    def make():
        rows = vec14(spark, sf_dir)
        centres = kmeans.lloyd(rows, kmeans.seeds(rows, n_clusters, DIM), rounds, 0)
        vectors = materialise(kmeans.dealt(rows, centres), "index-vectors")
        clusters = materialise(clusters_of(vectors, centres), "index-clusters")
        if clusters.agg(F.sum("n")).first()[0] != rows.count():
            raise ValueError("the index is not complete")
        return clusters, vectors

    return _once(spark, sf_dir, f"index14-{n_clusters}-{rounds}", make)
