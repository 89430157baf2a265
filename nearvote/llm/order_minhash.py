"""Near-duplicate detection with Order MinHash.

A document is its sequence of five-word shingles, each labelled with its occurrence number, so that no label comes
twice. A sketch takes the `PICKS` labelled shingles with the smallest hashes and keeps them in text order; documents
that share one of `SKETCHES` sketches are candidates. Candidates are verified by a banded alignment of the labelled
shingles: with M aligned shingles of two documents of n and m, the similarity is M / (n + m - M), the Jaccard
similarity if order is kept and less if it isn't, and 0.8 or more makes a link. As labels are unique, the alignment
is a longest increasing run of matching places, found in n log n within the band that 0.8 allows. Texts with the same
words are one node from the start.

1. Every member of a bucket is aligned with one chosen member, which settles copies and most families in one pass of
   linear size. Buckets whose members are then in one class are done.
2. The other buckets are rehashed where they hold more than `BIG` nodes: each node goes to buckets of its smallest labels
   under an order that puts shared labels last. A pair that can reach 0.8 must share one of the first
   n - 2 * 0.8 n / 1.8 + 1 labels of its shorter text and the first m - 0.8 m + 1 of its longer one, in any order, so no
   pair of the bucket is lost; and the labels of a passage that many share are left out of it, unless texts hardly
   have any others.
   One member of each of these buckets is aligned with the others again.
3. All pairs from different classes that meet in these small buckets are tried against three exact bounds (sizes, labels
   that come after the shared one, bit maps of 1024 cells), vectorised over blocks of at most `BLOCK` nodes. Pairs of blocks, not buckets,
   are what a task gets, so that a bucket of any size needs no more memory. Only pairs within the bounds become rows; they
   are aligned if they are still in different classes after each node was aligned with one partner.

So every pair that shares a sketch is aligned, ruled out by a bound, or in one class already, however large its bucket.

Words: A-Z as a-z, runs of ASCII letters, digits and all that isn't ASCII. Texts of one to four words are one shingle.
Defined results: a text without words (null, empty, only signs) is alone in its class; repeated rows share a class; the class
id is the smallest identifier in the class, null only if all are null; of rows with the smallest identifier and different texts
`deduplicate` keeps one; an empty table gives an empty table; other columns are not looked at by `classes` and kept by `deduplicate`.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, batches_of, cut, join_counted, lean, sealed, slim, text_column
from .text import ALNUM, Words, chunks, mix, powers, rolling

SHINGLE, SKETCHES, PICKS = 5, 12, 2
#: Chosen members: so many different ones over the sketches.
HEADS = 3
#: Buckets of more nodes are rehashed by their rarer labels.
BIG = 64
#: Nodes of a block; a task compares two blocks at a time.
BLOCK = 2048
#: Bits of a document's cells, as 64-bit words.
CELLS = 16
#: Cells in which labels of rehashed nodes are counted, as a power of two: 8 MB. The counts only order labels; any order is exact.
COUNT_BITS, COUNT_BLOCK = 21, 15
#: Rows of a batch with two whole documents each, and with the bit maps of one.
PAIR_ROWS, CELL_ROWS = 200, 4000
_ODD = np.random.default_rng(8).integers(0, 1 << 63, (2, SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shingles:
    """The occurrence-labelled shingles of a chunk of texts in text order, and each text's range of them."""

    def __init__(self, texts: list[str | None], n: int = SHINGLE):
        words = self.words = Words(texts, ALNUM)
        h, counts = words.hashes, words.counts
        self.counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        self.first = np.cumsum(self.counts) - self.counts
        self.text = np.repeat(np.arange(len(counts)), self.counts)
        inner = np.arange(len(self.text)) - self.first[self.text]
        at = words.first[self.text] + inner
        grams = np.zeros(len(at), np.uint64)
        long = counts[self.text] >= n
        if long.any():
            grams[long] = rolling(h, n)[at[long]]
        for k in range(1, n):
            short = counts[self.text] == k
            if short.any():
                grams[short] = rolling(h, k)[at[short]] ^ np.uint64(k)
        key = grams ^ mix(self.text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        begin = np.flatnonzero(new)
        number = np.zeros(len(key), np.uint64)
        number[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        self.labels = mix(grams + number * np.uint64(0x9E3779B97F4A7C15))

    def names(self) -> list[bytes]:
        """128 bits for each text's words."""
        w = self.words
        out = []
        for base in _BASES:
            m = base | 1
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * powers(m, len(w.hashes)), dtype=np.uint64)])
            first = np.minimum(w.first, max(len(w.hashes) - 1, 0))
            out.append(mix((total[w.last] - total[w.first]) * powers(pow(m, -1, 1 << 64), max(len(w.hashes), 1))[first] + w.counts.astype(np.uint64)))
        return [row.tobytes() for row in np.stack(out, axis=1)]

    def cells(self) -> np.ndarray:
        """For each text a bit map of the cells its labels fall into: a cell that only one of two texts has holds a label that the other lacks."""
        out = np.zeros((len(self.counts), CELLS * 64), bool)
        out[self.text, (self.labels >> np.uint64(54)).astype(np.int64)] = True
        return np.packbits(out, axis=1).view(np.int64)

    def sketches(self) -> np.ndarray:
        """For each text with words the hash of each sketch: picked labels in text order."""
        some = np.flatnonzero(self.counts)
        out = np.zeros((len(some), SKETCHES), np.uint64)
        if not len(some):
            return out
        first, counts = self.first[some], self.counts[some]
        many = np.flatnonzero(counts >= PICKS)
        for i in range(SKETCHES):
            value = (self.labels ^ _ODD[0, i]) * _ODD[1, i]
            value ^= value >> np.uint64(32)
            picked = []
            for p in range(PICKS):
                low = np.minimum.reduceat(value, first)
                here = np.flatnonzero(value == np.repeat(low, counts))
                of = np.searchsorted(first, here, "right") - 1
                place = np.full(len(some), -1)
                place[of[::-1]] = here[::-1]  # the first of equals
                picked.append(place)
                value[place] = _LAST
            places = np.sort(np.stack(picked), axis=0)
            total = np.full(len(some), i + 1, np.uint64)
            single = np.ones(len(some), bool)
            single[many] = False
            for row in places:
                total = mix(total * np.uint64(0xD6E8FEB86659FD93) + np.where(single, self.labels[first], self.labels[row]))
            out[:, i] = total
        return out


def similarity(a: np.ndarray, b: np.ndarray, at_least: float) -> float:
    """M / (n + m - M) for the aligned labels of two texts; 0 where it can't reach at_least."""
    n, m = len(a), len(b)
    if min(n, m) < at_least * max(n, m):
        return 0.0
    need = at_least * (n + m) / (1 + at_least)
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    at[at == m] = 0
    place = order[at]
    hit = np.flatnonzero(b[place] == a)
    band = n + m - 2 * need  # insertions and deletions in all
    hit = hit[np.abs(place[hit] - hit) <= band]
    if len(hit) < need - 1e-9:
        return 0.0
    path = place[hit]
    if (path[1:] > path[:-1]).all():
        aligned = len(path)
    else:
        tails: list[int] = []
        for x in path.tolist():
            k = bisect.bisect_left(tails, x)
            tails[k : k + 1] = [x]
        aligned = len(tails)
    return aligned / (n + m - aligned)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, th, node, size, sketches of docs (doc_id, th, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                s = Shingles(texts[a:b])
                ends = np.cumsum(np.where(s.counts > 0, SKETCHES, 0))
                values = pa.array(s.sketches().ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.names(), pa.binary()), pa.array(s.counts, pa.int32()), lists], ["doc_id", "th", "node", "size", "sketches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(work), f"doc_id {kind}, th bigint, node binary, size int, sketches array<bigint>")


def _labelled(docs: DataFrame) -> DataFrame:
    """id, size, labels, cells of docs (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                s = Shingles(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(s.counts)), pa.int32()), pa.array(s.labels.view(np.int64)))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * CELLS, pa.int32()), pa.array(s.cells().ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s.counts, pa.int32()), lists, cells], ["id", "size", "labels", "cells"])

    return docs.mapInArrow(lean(work), "id bigint, size int, labels array<bigint>, cells array<bigint>")


def _common(n: Column, m: Column, a: Column, b: Column) -> Column:
    """The most labels that texts of n and m labels with cells a and b can have in common: every cell of one alone costs it a label."""
    alone = lambda x, y: reduce(add, [F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(CELLS)])
    return F.least(n - alone(a, b), m - alone(b, a))


def _fitting(pairs: DataFrame, labels: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) that sizes and cells don't rule out."""
    side = lambda x: labels.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.least("na", "nb") >= F.lit(at_least) * F.greatest("na", "nb") - F.lit(1e-6)
    need = F.lit(at_least / (1 + at_least)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)
    return both.where(near & (_common(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb")) >= need)).select("a", "b")


def _verified(pairs: DataFrame, labels: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches at_least."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    known = labels.select("id", "labels").join(wanted, "id", "left_semi")
    both = pairs.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b").select("a", "b", "la", "lb")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb = batch.column(2), batch.column(3)
            keep = [similarity(la[i].values.to_numpy(), lb[i].values.to_numpy(), at_least) >= at_least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(lean(align), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of links (a, b)."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "comps")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        near = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("comp"))
        far = near.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left")
        new = cut(far.select("node", "old", F.least("comp", "next").alias("comp")), "comps")
        labels = new.select("node", "comp")
        if new.where("old != comp").isEmpty():
            return labels


class Classes:
    """The classes found so far: node, comp for the nodes that have links."""

    def __init__(self, spark):
        self.spark, self.table = spark, None

    def of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        if self.table is None:
            return rows.withColumn(name, F.col(node))
        found = self.table.select(F.col("node").alias(node), F.col("comp").alias("__c"))
        return rows.join(found, node, "left").withColumn(name, F.coalesce("__c", node)).drop("__c")

    def link(self, pairs: DataFrame) -> None:
        ends = self.of(self.of(pairs, "a", "ca"), "b", "cb")
        with batches_of(self.spark, PAIR_ROWS):
            links = cut(ends.select("ca", "cb", "a", "b"), "links")
        if links.isEmpty():
            return
        joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        nodes = links.select(F.col("a").alias("node"), F.col("ca").alias("comp")).unionByName(links.select(F.col("b").alias("node"), F.col("cb").alias("comp")))
        nodes = (nodes if self.table is None else nodes.unionByName(self.table)).distinct()
        moved = nodes.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
        self.table = cut(moved.select("node", F.coalesce("now", "comp").alias("comp")), "classes")


def _counts(labels: DataFrame) -> np.ndarray:
    """In how many rows labels of each cell come: one pass, counts added up cell block by cell block."""
    size = 1 << COUNT_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint64)
            np.add.at(total, (values >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        for block in range(len(total) // size):
            part = total[block * size : (block + 1) * size]
            some = np.flatnonzero(part)
            if len(some):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": pa.array([some.astype("<u2").tobytes()], pa.binary()), "n": pa.array([part[some].astype("<i8").tobytes()], pa.binary())})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = totals.setdefault(r["block"], np.zeros(size, np.int64))
                total[np.frombuffer(r["cells"], "<u2")] += np.frombuffer(r["n"], "<i8")
        for block, total in totals.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "n": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(1 << COUNT_BITS, np.uint32)
    merged = labels.select("labels").mapInArrow(lean(count), "block int, cells binary, n binary").repartition("block").mapInArrow(add_up, "block int, n binary")
    for r in merged.collect():  # a fixed number of cells
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["n"], "<u4")
    return out


def _rehashed(labels: DataFrame, at_least: float) -> DataFrame:
    """bucket, id, c, size, place, short, cells, before (the node's other labels up to this one): labels that a similar text can't all lack, rarest first.

    Similar texts of n <= m labels have at_least / (1 + at_least) * (n + m) in common, so whatever the order of all labels, one is among
    the first n - 2 * at_least / (1 + at_least) * n + 1 of the shorter text (short) and the first m - at_least * m + 1 of the longer.
    """
    sent = labels.sparkSession.sparkContext.broadcast(_counts(labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells = batch.column(1).to_numpy(), batch.column(3)
            lists = batch.column(2)
            for begin in range(0, batch.num_rows, 64):
                bucket, row, place, short, before = [], [], [], [], []
                for i in range(begin, min(begin + 64, batch.num_rows)):
                    own, n = lists[i].values.to_numpy(), int(sizes[i])
                    often = sent.value[(own.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                    first = np.lexsort((own, often))[: n - int(np.ceil(at_least * n - 1e-6)) + 1]
                    at = np.flatnonzero(often[first] > 1)  # what no other node has finds no partner
                    bucket.append(own[first[at]])
                    before += [bucket[-1][:k] for k in range(len(at))]
                    place.append(at)
                    short.append(at <= n - int(np.ceil(2 * at_least / (1 + at_least) * n - 1e-6)))
                    row.append(np.full(len(at), i))
                rows = pa.array(np.concatenate(row), pa.int64())
                ends = np.cumsum([0, *map(len, before)])
                earlier = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *before])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), batch.column(0).take(rows), batch.column(4).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(short)), cells.take(rows), earlier], ["bucket", "id", "c", "size", "place", "short", "cells", "before"])

    return labels.select("id", "size", "labels", "cells", "c").mapInArrow(lean(work), "bucket bigint, id bigint, c bigint, size int, place int, short boolean, cells array<bigint>, before array<bigint>")


def _met(rows: DataFrame, at_least: float) -> DataFrame:
    """a, b: pairs of different classes in a bucket that no bound rules out; rows: bucket, n (nodes in it), id, size, c, place, short, cells, before.

    A pair with several labels in common is looked at in the bucket of the first, where the bound by place holds, and nowhere else.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("id", F.lit(1)), blocks)
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    unit = F.when(F.col("n") <= BLOCK, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    # in the unit of two blocks those of one block have met elsewhere
    dealt = dealt.select(unit.alias("unit"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).cast("long").alias("block"), "id", "size", "c", "place", "short", "cells", "before")
    share = at_least / (1 + at_least)

    def compare(unit, block, node, size, c, place, short, cells, before) -> np.ndarray:
        last = np.append(np.flatnonzero(unit[1:] != unit[:-1]), len(unit) - 1)
        end = last[np.searchsorted(last, np.arange(len(unit)))]
        out, x, d = [], np.arange(len(unit)), 0
        while True:
            d += 1
            x = x[x + d <= end[x]]
            if not len(x):
                break
            a, b = x, x + d
            keep = (c[a] != c[b]) & ((block[a] != block[b]) | (block[a] < 0))
            a, b = a[keep], b[keep]
            need = share * (size[a] + size[b]) - 1e-6
            keep = np.minimum(size[a], size[b]) >= at_least * np.maximum(size[a], size[b]) - 1e-6
            keep &= np.where(size[a] < size[b], short[a], np.where(size[b] < size[a], short[b], short[a] | short[b]))
            keep &= np.minimum(size[a] - place[a], size[b] - place[b]) >= need
            a, b, need = a[keep], b[keep], need[keep]
            if len(a):
                alone = lambda s, t: np.bitwise_count(cells[s] & ~cells[t]).sum(1, dtype=np.int64)
                keep = np.minimum(size[a] - alone(a, b), size[b] - alone(b, a)) >= need
                a, b = a[keep], b[keep]
                first = np.array([before[i].isdisjoint(before[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
                out.append(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])])[:, first])
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(n: int) -> Iterator[pa.RecordBatch]:
            found = compare(*(x[:n] for x in held))
            for begin in range(0, found.shape[1], 1 << 16):
                a, b = found[:, begin : begin + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            new.append(batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, CELLS))
            sets = np.empty(batch.num_rows, object)
            sets[:] = [frozenset(x) for x in batch.column(8).to_pylist()]
            new.append(sets)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            n = int(np.searchsorted(-(held[0] != held[0][-1]).astype(int), 0))  # the last unit may go on in the next batch
            if n:
                yield from done(n)
                held = [x[n:] for x in held]
        if held:
            yield from done(len(held[0]))

    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(work, CELL_ROWS), "a bigint, b bigint")


def _several(rows: DataFrame, *more: Column) -> DataFrame:
    """bucket, n and more for the buckets of rows (bucket, id, c, and short if any) that hold several classes and a node that can be the shorter one."""
    short = F.count_if("short") if "short" in rows.columns else F.count("*")
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), short.alias("n_short"), *more)
    return found.where("low != high AND n_short > 0").drop("low", "high", "n_short")


def _find(nodes: DataFrame, labels_of, at_least: float) -> Classes:
    """Classes of nodes (id, size, sketches)."""
    classes = Classes(nodes.sparkSession)
    total = SKETCHES * nodes.count()
    flat = nodes.select("id", F.posexplode("sketches").alias("i", "bucket"))
    head = F.min(F.struct(F.xxhash64("id", F.col("i") % HEADS).alias("h"), "id"))["id"]
    counts = cut(flat.groupBy("bucket").agg(F.count("*").alias("n"), head.alias("head")).where("n > 1"), "counts")
    live = cut(join_counted(flat.drop("i"), counts, ["bucket"], "n", total), "live")
    with batches_of(nodes.sparkSession, TEXT_ROWS):
        labels = cut(labels_of(live.select("id").distinct()), "labels")
    # every bucket's chosen member settles what is like it
    star = cut(_fitting(live.where("id != head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct(), labels, at_least), "star")
    classes.link(_verified(star, labels, at_least))
    # buckets with members of different classes; of two members both have met
    now = cut(classes.of(live.where("n > 2").select("bucket", "id"), "id", "c"), "now")
    left = cut(join_counted(now, _several(now), ["bucket"], "n", total), "left")
    columns = ["bucket", "id", "c", "size", "place", "short", "cells", "before"]
    small = left.where(F.col("n") <= BIG).join(labels.select("id", "size", "cells"), "id").withColumns({"place": F.lit(0), "short": F.lit(True), "before": F.array().cast("array<bigint>")})
    big = labels.join(left.where(F.col("n") > BIG).select("id").distinct(), "id", "left_semi")
    with batches_of(nodes.sparkSession, TEXT_ROWS):
        rare = cut(_rehashed(cut(classes.of(big, "id", "c"), "big"), at_least), "rare")  # classes are looked up by node, not by row
    buckets = cut(small.select(columns).unionByName(rare.select(columns)), "buckets")
    # these buckets' chosen members settle what the first ones didn't
    heads = _several(buckets, F.min(F.struct(F.xxhash64("id", F.lit(HEADS)).alias("h"), "id", "c")).alias("head"))
    with batches_of(nodes.sparkSession, CELL_ROWS):
        contested = cut(join_counted(buckets, heads, ["bucket"], "n", total), "contested")
    again = contested.where("c != head.c").select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    again = cut(_fitting(again, labels, at_least), "again")
    classes.link(_verified(again, labels, at_least))
    # all other pairs from different classes; classes only grow, so buckets with one class then have one now
    now = cut(classes.of(contested.select("bucket", "id", "size", "place", "short", "cells", "before"), "id", "c"), "now")
    rows = join_counted(now, _several(now), ["bucket"], "n", total)
    pairs = _met(rows, at_least).distinct().join(star, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti")
    with batches_of(nodes.sparkSession, CELL_ROWS):
        pairs = cut(pairs, "pairs")
    # each node with one partner first; pairs whose ends are then in one class need no look
    rank = F.struct(F.xxhash64("a"), "a")
    first = cut(pairs.groupBy("b").agg(F.min(F.struct(rank.alias("r"), "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "first")
    classes.link(_verified(first, labels, at_least))
    rest = classes.of(classes.of(pairs, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b").join(first, ["a", "b"], "left_anti")
    classes.link(_verified(cut(rest, "rest"), labels, at_least))
    return classes


def _grouped(docs: DataFrame, at_least: float) -> DataFrame:
    """doc_id, th, class_id, class_size, stays (of each class one text's rows) for each row of docs (doc_id, th, text)."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        rows = cut(_sketched(docs), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    own = rows.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("sketches").alias("sketches"), one.alias("one"), F.count("*").alias("n"))
    nodes = cut(own.withColumn("id", F.monotonically_increasing_id()), "nodes")

    def labels_of(wanted: DataFrame) -> DataFrame:
        which = wanted.join(nodes.select("id", "one"), "id").select("id", F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th"))
        texts = docs.join(which, docs["doc_id"].eqNullSafe(which["__id"]) & (docs["th"] == which["__th"])).select("id", "text")
        return _labelled(texts.dropDuplicates(["id"]))

    classes = _find(nodes.select("id", "size", "sketches"), labels_of, at_least)
    comps = cut(classes.of(nodes.select("id", "node", "one", "n"), "id", "comp"), "own")
    ids = comps.groupBy("comp").agg(F.min("one").alias("least"), F.sum("n").alias("class_size"), F.count("*").alias("n_nodes"))
    named = cut(join_counted(comps.drop("one"), ids, ["comp"], "n_nodes", nodes.count()).select("node", "n", "least", "class_size"), "named")
    wordy = join_counted(rows.where("size > 0").select("doc_id", "th", "node"), named, ["node"], "n", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    alone = rows.where("size = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return wordy.select("doc_id", "th", F.col("least.doc_id").alias("class_id"), "class_size", stays.alias("stays")).unionByName(alone)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_column(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def report(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size (rows of the class): a row for each row of docs."""
    return _grouped(_hashed(slim(docs, id_col, text_col), "doc_id", "text"), at_least).select("doc_id", "class_id", "class_size")


def classes(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: a row for each row of docs."""
    return report(docs, at_least, id_col, text_col).drop("class_size")


def deduplicate(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, that with the smallest identifier, with the columns of docs."""
    id_col, text_col = (f"col{docs.columns.index(c)}" for c in (id_col, text_col))
    docs, names = sealed(docs)
    stay = _grouped(_hashed(docs, id_col, text_col), at_least).where("stays").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th2"))
    keyed = docs.withColumn("__th", F.xxhash64(text_column(text_col)))
    return keyed.join(stay, keyed[id_col].eqNullSafe(stay["__id"]) & (F.col("__th") == F.col("__th2")), "left_semi").dropDuplicates(["__th", id_col]).select(docs.columns).toDF(*names)
