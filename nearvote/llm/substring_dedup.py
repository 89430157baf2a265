"""Substring deduplication with a count-min prefilter.

A window is `window` words in a row. Its anchor is the smallest hash among the word grams in it, so equal windows
have equal anchors, and windows that follow one another mostly share theirs: a run of windows with one anchor is a
segment, and there are some sixteen times fewer segments than windows.

First pass: every partition counts the anchors of its documents in a count-min sketch; the sketches are added up, block
by block. As an anchor is counted at least once for each document that has it, and the sketch only overestimates, a
window that two documents share has an estimate of at least two. Second pass: only segments estimated repeated are
written, with the hashes of their windows, and grouped exactly: first whole segments, which settles copies of any
number with a row for each different segment; then, where an anchor has different segments, the windows of
one copy of each. None is lost, and none is dropped unless its whole word sequence is repeated: it is named by 64 bits of
anchor and 64 of window.

Words are runs of anything but ASCII white space. Defined results: a null text has no words; windows of rows with
one identifier don't remove one another; rows with a null identifier keep all words and remove none; texts shorter
than a window stay; an empty table gives an empty table; other columns are not looked at by `report` and kept by `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_counted, lean, sealed, slim, text_column
from .text import SPACED, Words, chunks, mix, rolling

#: Words of a gram that can be an anchor, for windows long enough.
GRAM = 16
#: Most windows in a segment.
SEGMENT = 64
#: The sketch: rows, cells in a block, and the largest number of cells as a power of two (128 MB a row as bits, which every worker
#: holds). It is sized by the bytes of all texts; from 27 GB on it stays as it is and filters less, with the same results.
DEPTH, BLOCK_BITS, MOST_BITS = 2, 16, 30
#: Bytes of text for each cell; an anchor comes every hundred bytes or so.
BYTES_A_CELL = 25
_ROWS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchors ^ _ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _lowest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every n values in a row."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Windows:
    """The windows of a chunk: the place of each, its text, its anchor and where segments begin."""

    def __init__(self, texts: list[str | None], window: int):
        gram = min(GRAM, window)
        self.words = words = Words(texts, SPACED)
        left = np.repeat(words.last, words.counts) - np.arange(len(words.hashes))
        self.at = np.flatnonzero(left >= window)
        self.anchor = _lowest(rolling(words.hashes, gram), window - gram + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.text = words.text_of()[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        self.new = new


def sketch(docs: DataFrame, window: int, bits: int, text_col: str = "text") -> list[np.ndarray]:
    """The merged count-min sketch: for each row, bits of the cells with a count of two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint64)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window)
                seen.append(w.anchor[w.new])
        anchors = np.concatenate(seen)
        for row in range(DEPTH):
            cells, n = np.unique(_cells(anchors, row, bits), return_counts=True)
            edges = np.flatnonzero(np.diff(cells >> BLOCK_BITS, prepend=-1)) if len(cells) else []
            for begin, end in zip(edges, [*edges[1:], len(cells)], strict=False):
                block = int(cells[begin] >> BLOCK_BITS)
                low = (cells[begin:end] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes()
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "cells": pa.array([low], pa.binary()), "counts": pa.array([np.minimum(n[begin:end], 255).astype(np.uint8).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "repeated": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

        key, total = None, np.zeros(1 << BLOCK_BITS, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["row"], r["block"]):
                    if key is not None:
                        yield done()
                    key, total = (r["row"], r["block"]), np.zeros(1 << BLOCK_BITS, np.int64)
                total[np.frombuffer(r["cells"], "<u2")] += np.frombuffer(r["counts"], np.uint8)
        if key is not None:
            yield done()

    parts = docs.select(text_col).mapInArrow(lean(count), "row int, block int, cells binary, counts binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(add, "row int, block int, repeated binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():  # bits of a bounded number of cells
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["repeated"], np.uint8)
    return out


def _segments(docs: DataFrame, window: int, bits: int, repeated: list[np.ndarray]) -> DataFrame:
    """doc_id, th, pos, v, s, windows: the segments estimated repeated of docs (doc_id, th, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window)
                begin = np.flatnonzero(w.new)
                anchors = w.anchor[begin]
                may = np.ones(len(begin), bool)
                for row, table in enumerate(tables):
                    cell = _cells(anchors, row, bits)
                    may &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                n = np.diff(np.append(begin, len(w.at)))[may]
                begin = begin[may]
                if not len(begin):
                    continue
                hashes = rolling(w.words.hashes, window)[w.at].view(np.int64)
                # long runs of one anchor are cut
                pieces = -(-n // SEGMENT)
                k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(begin, pieces) + k * SEGMENT
                size = np.minimum(SEGMENT, np.repeat(begin + n, pieces) - start)
                ends = np.cumsum(size)
                inner = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
                values = hashes[inner]
                place = np.arange(ends[-1]) - np.repeat(ends - size, size)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
                name = mix((total[ends] - total[ends - size]) ^ size.astype(np.uint64)).view(np.int64)
                text = w.text[start]
                pos = w.at[start] - w.words.first[text]
                rows = pa.array(text + a, pa.int64())
                windows = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(w.anchor[start].view(np.int64)), pa.array(name), windows], ["doc_id", "th", "pos", "v", "s", "windows"])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["th"], T.StructField("pos", T.IntegerType()), T.StructField("v", T.LongType()), T.StructField("s", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(lean(pick), schema)


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, th, gone (places of the windows that go) of docs (doc_id, th, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(BLOCK_BITS, (size // BYTES_A_CELL).bit_length()))
    segments = cut(_segments(docs.where(F.col("doc_id").isNotNull()), window, bits, sketch(docs, window, bits)), "segments")
    # whole segments first: a row for each different one
    me, kind = F.struct("doc_id", "th", "pos"), docs.schema["doc_id"].dataType.simpleString()
    kinds = cut(segments.groupBy("v", "s").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most"), F.min(me).alias("one"), F.count("*").alias("n")), "kinds")
    anchors = kinds.groupBy("v").agg(F.min("m").alias("v_min"), F.max("most").alias("v_max"), F.count("*").alias("n_kinds")).where("v_min < v_max")
    anchors = cut(anchors, "anchors")
    total = kinds.count()
    shared = join_counted(kinds, anchors, ["v"], "n_kinds", total)
    alike = shared.where("n_kinds = 1").select("v", "s", "n", "m", F.lit(None).cast(f"array<{kind}>").alias("mins"))
    # then the windows of one copy of each of several segments with one anchor
    ones = shared.where("n_kinds > 1").select("v", "s", "m", "n", F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th"), F.col("one.pos").alias("pos"))
    several = segments.join(ones, ["v", "s", "doc_id", "th", "pos"]).dropDuplicates(["v", "s"])
    windows = cut(several.select("v", "s", "n", "m", F.posexplode("windows").alias("o", "w")), "windows")
    least = windows.groupBy("v", "w").agg(F.min("m").alias("least"), F.count("*").alias("n_w"))
    known = join_counted(windows, cut(least, "least"), ["v", "w"], "n_w", windows.count())
    mixed = known.groupBy("v", "s", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "least"))), lambda x: x.least).alias("mins"))
    mixed = mixed.select("v", "s", "n", F.lit(None).cast(kind).alias("m"), "mins")
    verdicts = cut(alike.unionByName(mixed), "verdicts")
    judged = join_counted(segments.withColumn("k", F.size("windows")).drop("windows"), verdicts, ["v", "s"], "n", segments.count())
    every = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.col("pos") + i)
    some = F.filter(F.transform("mins", lambda m, i: F.when(m < F.col("doc_id"), F.col("pos") + i)), lambda x: x.isNotNull())
    gone = F.when(F.col("mins").isNotNull(), some).when(F.col("m") < F.col("doc_id"), every)
    judged = judged.select("doc_id", "th", gone.alias("gone")).where(F.size("gone") > 0)
    return judged.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def _cleaned(docs: DataFrame, window: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """digest: docs with __n_words, __n_removed and __sha256 (of the words that stay, joined by a space) in place of the text; else docs with clean texts."""
    text = text_column(text_col)
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    gone = _removed(hashed, window).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th2"), F.col("gone").alias("__gone"))
    keyed = docs.withColumn("__th", F.xxhash64(text))
    both = keyed.join(gone, (keyed[id_col] == gone["__id"]) & (F.col("__th") == F.col("__th2")), "left").drop("__id", "__th", "__th2")
    at = docs.columns.index(text_col)

    def rebuilt(batch: pa.RecordBatch) -> tuple[list[int], list[int], list]:
        n_words, n_removed, kept = [], [], []
        texts, gone = batch.column(at), batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            t, places = texts[i].as_py(), gone[i].as_py()
            if not digest and not places:
                kept.append(t)
                continue
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if places:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, np.array(places) + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            clean = b" ".join(words)
            kept.append(hashlib.sha256(clean).hexdigest() if digest else clean.decode("utf-8", "surrogatepass"))
        return n_words, n_removed, kept

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = rebuilt(batch)
            rest = [c for k, c in enumerate(batch.columns[:-1]) if k != at]
            if digest:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*rest[:at], pa.array(kept, pa.string()), *rest[at:]], schema.names)

    if digest:
        fields = [f for f in docs.schema.fields if f.name != text_col]
        schema = T.StructType([*fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__sha256", T.StringType())])
    else:
        schema = docs.schema
    return both.mapInArrow(lean(rebuild), schema)


def report(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of docs."""
    return _cleaned(slim(docs), window, "doc_id", "text", True).toDF("doc_id", "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages taken out of the text; texts that lose nothing stay as they are."""
    id_col, text_col = (f"col{docs.columns.index(c)}" for c in (id_col, text_col))
    docs, names = sealed(docs)
    return _cleaned(docs, window, id_col, text_col, False).select(docs.columns).toDF(*names)
