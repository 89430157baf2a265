"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches. A batch's line hashes are counted, merge-anti-joined with the lines that a run already knows to be
frequent, and written as a run of level 0: a table bucketed and sorted by hash, so that runs meet bucket by bucket, in order,
without an exchange or a sort. As soon as a level holds `fan_out` runs, they are merged into one run of the next level by full outer merge joins. At the
end all runs are merged in the same way and give the frequent lines, and documents that hold any are rebuilt without them.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case; 128 bits of hash stand for it.
Defined results: a null or empty text is one empty line; keys shorter than `min_chars` are never dropped; documents are
counted by identifier (rows with one identifier count once, a null identifier doesn't count); an empty table
gives an empty table; other columns are not looked at by `line_report` and kept by `deduplicate_lines`.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_counted, new_path, sealed, slim, text_column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
HASH = ["a", "b"]
#: Bytes of text in a batch, and the least number of batches.
BATCH_BYTES, BATCHES = 1 << 40, 4


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keys_of(text: Column) -> Column:
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda line: F.btrim(line, F.lit(SPACE)))


@contextlib.contextmanager
def _in_order(spark) -> Iterator[None]:
    """Within it, scans of bucketed tables say in which order they are: each bucket is one sorted file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LevelledRuns:
    """Sorted runs of (a, b, n): line hash and number of documents, in levels, as bucketed tables in a folder all executors share."""

    def __init__(self, spark, path: str, at_least: int, fan_out: int):
        self.spark, self.path, self.at_least, self.fan_out = spark, path, at_least, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []

    def _write(self, run: DataFrame, level: int) -> None:
        """run comes dealt out by HASH, each bucket in one task, and so in one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        with _in_order(self.spark):
            writer = run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("compression", "zstd")
            writer.option("path", f"{self.path}/level{level}-{name}").format("parquet").saveAsTable(name)
        self.tables.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """The sums of runs, by merge joins of tables in the same order."""
        both = lambda x, y: x.join(y.withColumnRenamed("n", "m").hint("merge"), HASH, "full_outer").select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return reduce(both, [self.spark.table(x) for x in names])

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, a, b of a batch; documents of one identifier must be in one batch."""
        run = lines.where(F.col("doc_id").isNotNull()).distinct().groupBy(*HASH).agg(F.count("*").alias("n"))
        with _in_order(self.spark):
            for name in (x for level in self.levels for x in level):
                known = self.spark.table(name).where(F.col("n") >= self.at_least).select(*HASH, F.lit(True).alias("known"))
                # an anti-join proper would be moved below the counting, where a line has a row for each document that holds it
                run = run.join(known.hint("merge"), HASH, "left").where("known is null").drop("known")
        self._write(run, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            names, self.levels[level] = self.levels[level], []
            with _in_order(self.spark):
                merged = self._merged(names)
            self._write(merged, level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """a, b, n of the lines in at least `at_least` documents; those that a run knew to be frequent weren't counted on."""
        with _in_order(self.spark):
            return cut(self._merged([x for level in self.levels for x in level]).where(F.col("n") >= self.at_least), "frequent")

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _dropped(docs: DataFrame, at_least: int, min_chars: int, batches: int | None, fan_out: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, drops: places of the lines that go, for each document that loses any."""
    spark, text = docs.sparkSession, text_column(text_col)
    if batches is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        batches = max(BATCHES, -(-size // BATCH_BYTES))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), keys_of(text).alias("keys"))
    hashed = F.transform("keys", lambda k, i: F.struct(i.alias("pos"), F.char_length(k).alias("n_chars"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b")))
    lines = keys.select("doc_id", "th", F.inline(F.filter(hashed, lambda x: x.n_chars >= min_chars))).drop("n_chars")
    path = new_path(spark, "lines")
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(T.StructType([*lines.schema, T.StructField("batch", T.IntegerType())])).parquet(path)
    runs = LevelledRuns(spark, new_path(spark, "runs"), at_least, fan_out)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", *HASH))
    frequent = runs.frequent()
    runs.drop()
    hits = join_counted(lines.drop("batch"), frequent, HASH, "n", lines.count())
    return hits.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops"))


def _rebuilt(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __lines, __drops (null: none) and __kept, the text that stays."""
    text = text_column(text_col)
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th2"), F.col("drops").alias("__drops"))
    both = docs.withColumn("__th", F.xxhash64(text))
    both = both.join(drops, both[id_col].eqNullSafe(drops["__id"]) & (F.col("__th") == F.col("__th2")), "left").drop("__id", "__th", "__th2")
    both = both.withColumn("__lines", lines_of(text))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.get("__lines", i)), "\n"))
    return both.withColumn("__kept", kept)


def line_report(docs: DataFrame, at_least: int = 10, min_chars: int = 1, batches: int | None = None, fan_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: a row for each row of docs."""
    docs = slim(docs, id_col, text_col)
    out = _rebuilt(docs, _dropped(docs, at_least, min_chars, batches, fan_out, "doc_id", "text"), "doc_id", "text")
    n_dropped = F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long")
    return out.select("doc_id", F.size("__lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def deduplicate_lines(docs: DataFrame, at_least: int = 10, min_chars: int = 1, batches: int | None = None, fan_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the frequent lines taken out of the text; all other columns as they were."""
    id_col, text_col = (f"col{docs.columns.index(c)}" for c in (id_col, text_col))
    docs, names = sealed(docs)
    out = _rebuilt(docs, _dropped(docs, at_least, min_chars, batches, fan_out, id_col, text_col), id_col, text_col)
    return out.withColumn(text_col, F.col("__kept")).select(docs.columns).toDF(*names)
