"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: one row for each different digest in it, with the identifier to keep and a
count. Runs are merged in binomial rounds: in round k, run r with bit k set sends its rows to run r - 2 ** k; an exchange does
`ROUNDS` of them at once, a merge of up to 2 ** ROUNDS runs, until run 0 is left. A run lies in lanes by a hash of its digests, so
that run 0, which has every digest, is no larger for a task than the others; the lanes of a run are exchanged whole, sorted, and
merged by one pass over the sorted rows. A run holds a digest once, so a text that fills a third of the corpus never puts more than
2 ** ROUNDS rows of one key into a task. Every second exchange is written, so a lost executor costs two at most. Digests are verified
at every level: the key of a run is the SHA-256 together with the length and an independent 64-bit hash of the text.

Defined results: null texts count as empty; a null identifier is smaller than any other; among repeated rows with
the kept identifier one stays, in `deduplicate` one of those whose columns have the smallest hash; an empty table gives an empty
table; other columns, whatever their names, are not looked at by `groups`, and `deduplicate` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, sealed, slim, text_column

KEY = ["digest", "n_bytes", "check"]
#: Binomial rounds in one exchange.
ROUNDS = 3


def _with_key(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    text = text_column(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        row.alias("row"),
        F.spark_partition_id().alias("run"),
    )


def tree_merge(rows: DataFrame, n_runs: int, fan_in: int = 1 << ROUNDS, keep: str = "smallest") -> DataFrame:
    """KEY, best (struct: the kept identifier and row), group_size; rows: KEY, doc_id, row, run (0 to n_runs-1).

    fan_in: runs merged at once, rounded up to a power of two. Of rows with the kept identifier the smallest is the best.
    """
    rounds = max(1, (fan_in - 1).bit_length())
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pick, row = (F.max, -F.col("row")) if keep == "largest" else (F.min, F.col("row"))
    place = ["run", "lane", *KEY]
    level = rows.withColumn("lane", F.pmod(F.hash("digest"), F.lit(lanes)))
    level = level.groupBy(*place).agg(pick(F.struct("doc_id", row.alias("row"))).alias("best"), F.count("*").alias("group_size"))
    done = 0
    while (n_runs - 1) >> done:
        done += rounds
        sent = level.withColumn("run", F.expr(f"shiftleft(shiftright(run, {done}), {done})"))
        runs = sent.repartition(lanes, "run", "lane").sortWithinPartitions(*place)
        level = runs.groupBy(*place).agg(pick("best").alias("best"), F.sum("group_size").alias("group_size"))
        if done // rounds % 2 == 0 and (n_runs - 1) >> done:
            level = cut(level, "runs")
    return level.drop("run", "lane")


def groups(docs: DataFrame, keep: str = "smallest", fan_in: int = 1 << ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(_with_key(slim(docs, id_col, text_col), "doc_id", "text", F.monotonically_increasing_id()), "digests")
    found = rows.agg(F.max("run"), F.count("*")).first()
    merged = cut(tree_merge(rows, (found[0] or 0) + 1, fan_in, keep), "merged")
    joined = join_counted(rows.drop("run"), merged, KEY, "group_size", found[1])
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.abs(F.col("best.row")) == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, keep: str = "smallest", fan_in: int = 1 << ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each different text, with the columns of docs."""
    id_col, text_col = (f"col{docs.columns.index(c)}" for c in (id_col, text_col))
    docs, names_before = sealed(docs)
    # maps have no hash of their own
    hashable = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes]
    whole = F.shiftrightunsigned(F.xxhash64(*hashable), 1)
    rows = cut(_with_key(docs, id_col, text_col, whole), "digests")
    merged = tree_merge(rows, (rows.agg(F.max("run")).first()[0] or 0) + 1, fan_in, keep)
    text = text_column(text_col)
    names = {k: f"__{k}" for k in KEY}
    keyed = docs.withColumns({"__digest": F.unhex(F.sha2(text, 256)), "__n_bytes": F.octet_length(text), "__check": F.xxhash64(text), "__row": whole})
    stay = merged.select(*(F.col(k).alias(v) for k, v in names.items()), F.col("best.doc_id").alias("__keep"), F.abs(F.col("best.row")).alias("__one"))
    on = [keyed[v] == stay[v] for v in names.values()] + [keyed[id_col].eqNullSafe(stay["__keep"]), keyed["__row"] == stay["__one"]]
    # the join deals rows out by the same columns, so that repeated rows are found without another exchange
    return keyed.join(stay, on, "left_semi").dropDuplicates([*names.values(), id_col, "__row"]).select(docs.columns).toDF(*names_before)
