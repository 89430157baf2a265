"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed into thousands of slots, bytes are summed for each slot, and a slot-to-shard map, a table with a
version, says where each slot lives. The number of slots never changes. Rebalancing loads the last version of the map, edits it, that is, moves slots
from the fullest shard to the emptiest, and writes the result with its edits as the next version; records keep their slots.

The slot comes from the text, so equal texts share a slot and a shard. The one exception are texts whose copies hold more bytes than
a shard's fair share, of which there are fewer than shards: no map could be balanced with them in one slot. They are split, by the hash of
their identifiers, over some of the `RESERVED` slots a shard that are kept for this; the map remembers which, and `split` marks their rows.

Defined results: a null text has no bytes; null identifiers are ordinary values; repeated rows get places of their own;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, new_path, slim, text_column

SLOTS = 4096
#: Slots for each shard that are kept for texts heavier than a shard.
RESERVED = 8
#: Parts of a slot that are numbered apart: a slot may hold a fortieth of all rows, and none is sorted whole.
PARTS = 32


@dataclass
class SlotMap:
    """Where each slot lives. edits: (slot, from, to) since the version before; splits: the texts that have slots of their own."""

    n_shards: int
    shards: list[int]
    version: int = 1
    edits: list[tuple[int, int, int]] = field(default_factory=list)
    splits: list[dict] = field(default_factory=list)

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_shards, [s % n_shards for s in range(n_slots)])

    def with_splits(self, hot: list[tuple[int, int, int]], n_slots: int) -> SlotMap:
        """hot: (hash, crc, slots wanted) of texts that are too heavy; those not split yet get the next free slots from n_slots on."""
        splits = list(self.splits)
        known = {(x["h"], x["text_crc32"]) for x in splits}
        free = max([n_slots, *(x["first"] + x["n"] for x in splits)])
        for h, crc, n in sorted(hot):
            if (h, crc) not in known and free + n <= len(self.shards):
                splits.append({"h": h, "text_crc32": crc, "first": free, "n": n})
                free += n
        return SlotMap(self.n_shards, self.shards, self.version, self.edits, splits)

    def rebalanced(self, weights: list[int]) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that evens them out."""
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        total = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            if weights[slot]:
                held[shard].append((weights[slot], slot))
                total[shard] += weights[slot]
        for h in held:
            h.sort()
        moved: dict[int, int] = {}
        while True:
            most = max(range(self.n_shards), key=total.__getitem__)
            least = min(range(self.n_shards), key=total.__getitem__)
            gap = total[most] - total[least]
            at = bisect.bisect_left(held[most], (gap, -1)) - 1
            half = bisect.bisect_right(held[most], (gap // 2, 1 << 62)) - 1
            # the slot that comes nearest to half the gap, below it or above
            best = min((i for i in (half, half + 1) if 0 <= i <= at), key=lambda i: abs(2 * held[most][i][0] - gap), default=None)
            if best is None:
                break
            weight, slot = held[most].pop(best)
            bisect.insort(held[least], (weight, slot))
            total[most] -= weight
            total[least] += weight
            moved[slot] = least
        shards = [moved.get(s, x) for s, x in enumerate(self.shards)]
        edits = [(s, self.shards[s], x) for s, x in enumerate(shards) if x != self.shards[s]]
        return SlotMap(self.n_shards, shards, self.version + 1, edits, self.splits)

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, virtual_slot, shard, before (the shard one version earlier): a row for each slot."""
        # a literal, so that the map is part of the plan and comes from no machine's memory
        moved = {slot: old for slot, old, _ in self.edits}
        rows = F.from_json(F.lit(json.dumps([{"shard": x, "before": moved.get(s, x)} for s, x in enumerate(self.shards)])), "array<struct<shard:int,before:int>>")
        flat = spark.range(1).select(F.lit(self.version).alias("version"), F.posexplode(rows).alias("virtual_slot", "x"))
        return flat.select("version", "virtual_slot", "x.shard", "x.before")

    def split_frame(self, spark: SparkSession) -> DataFrame:
        """h, text_crc32, first, n: a row for each text with slots of its own."""
        rows = F.from_json(F.lit(json.dumps(self.splits)), "array<struct<h:bigint,text_crc32:bigint,first:int,n:int>>")
        return spark.range(1).select(F.inline(rows))

    def save(self, spark: SparkSession, path: str) -> None:
        self.split_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/splits/version={self.version}")
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_shards: int, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
        splits = [r.asDict() for r in spark.read.parquet(f"{path}/splits/version={version}").orderBy("first").collect()]
        edits = [(r["virtual_slot"], r["before"], r["shard"]) for r in rows if r["before"] != r["shard"]]
        return cls(n_shards, [r["shard"] for r in rows], version, edits, splits)

    @staticmethod
    def last_version(spark: SparkSession, path: str) -> int:
        """The highest version under path; 0 if there is none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in store.listStatus(folder)] if store.exists(folder) else []
        return max([0, *(int(x.partition("=")[2]) for x in found if x.startswith("version="))])


def assign(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the place in the shard), grown_shard, virtual_slot, map_version, split.

    The map is kept at map_path (a new place in the shared folder by default), a table for each version. A map that is there already
    is edited; it must have been made for n_shards and n_slots.
    """
    spark, text = docs.sparkSession, text_column()
    rows = slim(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.spark_partition_id().alias("salt"),
    )
    rows = cut(rows, "sizes")
    share = (rows.agg(F.sum("size")).first()[0] or 0) / n_shards
    path = map_path or new_path(spark, "slot-map")
    wide = n_slots + RESERVED * n_shards
    version = SlotMap.last_version(spark, path)
    old = SlotMap.load(spark, path, n_shards, version) if version else SlotMap.initial(wide, n_shards)
    if len(old.shards) != wide or max(old.shards) >= n_shards:
        raise ValueError(f"the map at {path} is for other numbers of slots or shards")
    hot = rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("size")).where(F.col("size") > share).collect()  # fewer than n_shards
    # all together want at most five slots a shard
    split = old.with_splits([(r["h"], r["text_crc32"], -(-4 * r["size"] // max(1, int(share)))) for r in hot], n_slots)
    rows = rows.join(F.broadcast(split.split_frame(spark)), ["h", "text_crc32"], "left")
    slot = F.when(F.col("n").isNull(), F.pmod("h", F.lit(n_slots))).otherwise(F.col("first") + F.pmod(F.xxhash64("doc_id"), "n")).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "h", "salt"), F.lit(PARTS)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "h", slot.alias("virtual_slot"), part.alias("part"), F.col("n").isNotNull().alias("split"))
    stats = cut(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slots")
    weights = [0] * wide
    for r in stats.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect():  # a row a slot
        weights[r["virtual_slot"]] = r["bytes"]
    new = split.rebalanced(weights)
    if not version:
        old.save(spark, path)
    new.save(spark, path)
    places = stats.join(F.broadcast(spark.read.parquet(f"{path}/version={new.version}")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most slots x PARTS rows
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "h"))
    return rows.withColumn("place", place).join(F.broadcast(places), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(new.version).alias("map_version"), "split",
    )
