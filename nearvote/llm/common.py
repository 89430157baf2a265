"""What the operators in this folder share: reading, cutting lineage, and joins that survive hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that hold more than this share of all rows are joined by broadcast; there are at most 1/share of them.
HOT_SHARE = 1e-4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, as doc_id and text, found by exact name whatever other columns are called."""
    neutral, _ = sealed(docs)
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)
    return neutral.select(F.col(f"col{i}").alias("doc_id"), F.col(f"col{t}").alias("text"))


def sealed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns named col0, col1 ..., which clash with nothing that operators add; and their names before."""
    return docs.toDF(*(f"col{i}" for i in range(len(docs.columns)))), docs.columns


def text_column(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the cluster's spark.checkpoint.dir, or its checkpoint folder.

    Where neither is set, on a local master only (single machines, tests), a temporary one is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            if not (spark.sparkContext.master + "[").startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get()
    return folder.rstrip("/")


#: Paths given out so far, by application.
_given: dict[str, list[str]] = {}


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the tables that operators wrote for this application; for when no result made from them is read any more."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


#: Rows with whole texts that a worker looks at together.
TEXT_ROWS = 500


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = TEXT_ROWS) -> Callable:
    """work over slices of at most so many rows, giving memory back at the end: workers live on, for other tasks and other work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batch.slice(begin, rows) for batch in batches for begin in range(0, batch.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions send at most so many rows at once to Python: for rows that hold whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and lost executors cost nothing before it."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups on keys, where groups has one row a key and `size` counts the key's rows.

    Keys with more than HOT_SHARE of `total` rows, fewer than 1/HOT_SHARE by arithmetic, are joined by broadcast
    where the rows are; the rest is shuffled, so no task gets a large group. how: inner or left.
    """
    bound = max(1000, int(total * HOT_SHARE))
    mark = "__hot"
    hot = F.broadcast(groups.where(F.col(size) > bound).withColumn(mark, F.lit(True)))
    extra = [c for c in groups.columns if c not in keys]
    if total <= bound:
        return rows.join(groups, keys, how)
    both = rows.join(hot, keys, "left")
    among = both.where(mark).drop(mark)
    rest = both.where(F.col(mark).isNull()).drop(mark, *extra).join(groups.where(F.col(size) <= bound), keys, how)
    return among.unionByName(rest.select(among.columns))
