"""A quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Boosting goes round the features in turn: a shallow tree over a
feature's bins is fitted to what is left of the labels and added, slowed down, to the feature's lookup table. Then
the pairs of features whose coarse bins explain most of the rest get tables of two dimensions, boosted in the same way with
trees of one cut each way. A text's score is the sum of its bins' entries, a few vectorised look-ups.

Features come from the whole text: shares of kinds of characters, word lengths, repetition, lines. The model is
fitted in numpy on the driver on at most `MOST_ROWS` labelled rows, those with the smallest hash of the identifier.

Defined results: a null text is an empty one and gets a score like any; repeated rows get equal scores; rows with a null
identifier are scored and never learned from; labels are the largest for an identifier, null labels are left out; without
labelled rows, or with one class only, all scores are that share; an empty table gives an empty table; other columns are
not looked at by `scored`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slim, text_column
from .text import SPACED, Words, chunks, mix

MOST_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "pipe", "comma_stop", "wide", "same_next", "distinct", "most_common", "words_a_line", "symbol_words", "long_words"]

_CLASS = np.zeros(256, np.uint8)  # 0 lower-case letters, white space
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[33, *range(35, 39), *range(40, 44), 47, *range(58, 65), *range(91, 97), 123, 125, 126]] = 3
_CLASS[124] = 4
_CLASS[[44, 46]] = 5
_CLASS[128:] = 6


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = Words(texts, SPACED)
    out = np.zeros((len(texts), len(FEATURES)))
    starts = w.text_starts
    ends = np.append(starts[1:], len(w.data))
    codes = _CLASS[np.frombuffer(w.data, np.uint8)]
    n_bytes = np.maximum(ends - starts - 1, 1)
    for column, kind in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)):
        total = np.concatenate([[0], np.cumsum(codes == kind)])
        out[:, column] = (total[ends] - total[starts]) / n_bytes
    lines = np.concatenate([[0], np.cumsum(np.frombuffer(w.data, np.uint8) == 10)])
    n = w.counts
    some = np.flatnonzero(n)
    out[:, 0] = np.log1p(n)
    out[:, 11] = n / np.maximum(lines[ends - 1] - lines[starts] + 1, 1)
    if len(some):
        first, count = w.first[some], n[some]
        size = w.ends - w.starts
        out[some, 1] = np.add.reduceat(size, first) / count
        out[some, 13] = np.add.reduceat(size > 12, first) / count
        same = np.zeros(len(size), bool)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        same[first] = False
        out[some, 8] = np.add.reduceat(same.astype(np.int64), first) / count
        tail = codes[w.ends - 1]
        out[some, 12] = np.add.reduceat(((tail == 3) | (tail == 4)).astype(np.int64), first) / count
        key = w.hashes ^ mix(w.text_of().astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        times = np.diff(np.append(edge, len(key)))
        owner = w.text_of()[order[edge]]
        out[some, 9] = np.bincount(owner, minlength=len(texts))[some] / count
        most = np.zeros(len(texts))
        np.maximum.at(most, owner, times)
        out[some, 10] = most[some] / count
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(grad: np.ndarray, weight: np.ndarray, cuts: int = 2, smooth: float = 4.0) -> np.ndarray:
    """The best step function over bins with at most `cuts` cuts, found one cut at a time."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + smooth)
    edges = [0, len(grad)]
    for _ in range(cuts):
        best = (1e-12, 0)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mid = np.arange(a + 1, b)
            if len(mid):
                more = gain(a, mid) + gain(mid, b) - gain(a, b)
                k = int(more.argmax())
                best = max(best, (float(more[k]), int(mid[k])))
        if best[1]:
            edges = sorted([*edges, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def _cross(grad: np.ndarray, weight: np.ndarray, smooth: float = 4.0) -> tuple[float, np.ndarray]:
    """The best table with one cut each way, and its gain."""
    g, h = grad.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, at = -1.0, None
    total_g, total_h = g[-1, -1], h[-1, -1]
    a = (g[:-1, :-1], g[:-1, -1:] - g[:-1, :-1], g[-1:, :-1] - g[:-1, :-1], total_g - g[:-1, -1:] - g[-1:, :-1] + g[:-1, :-1])
    b = (h[:-1, :-1], h[:-1, -1:] - h[:-1, :-1], h[-1:, :-1] - h[:-1, :-1], total_h - h[:-1, -1:] - h[-1:, :-1] + h[:-1, :-1])
    gain = sum(x**2 / (y + smooth) for x, y in zip(a, b, strict=True))
    at = np.unravel_index(gain.argmax(), gain.shape)
    best = float(gain[at])
    out = np.empty_like(grad)
    i, j = at[0] + 1, at[1] + 1
    for k, (rows, cols) in enumerate(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None)))):
        out[rows, cols] = a[k][at] / (b[k][at] + smooth)
    return best, out


class AdditiveModel:
    """base, a table for each feature, and tables for pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.coarse = [(np.arange(len(e) + 1) * COARSE) // (len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return
        bins = self.bins(x)
        score = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(k):
                p = _sigmoid(score)
                size = len(self.tables[j])
                step = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size))
                self.tables[j] += step
                score += step[bins[j]]
        p = _sigmoid(score)
        rough = [c[b] for c, b in zip(self.coarse, bins, strict=True)]
        grids = lambda i, j, v: np.bincount(rough[i] * COARSE + rough[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
        ranked = sorted(((_cross(grids(i, j, y - p), grids(i, j, p * (1 - p)))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
        chosen = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, grid in chosen:
                p = _sigmoid(score)
                step = RATE * _cross(grids(i, j, y - p), grids(i, j, p * (1 - p)))[1]
                grid += step
                score += step[rough[i], rough[j]]
        self.pairs = chosen

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        rough = [c[b] for c, b in zip(self.coarse, bins, strict=True)]
        for i, j, grid in self.pairs:
            total += grid[rough[i], rough[j]]
        return _sigmoid(total)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` allowed rows with a label; labels (at most `most` rows) go to where the texts are."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = slim(docs).select("doc_id", text_column().alias("text")).join(F.broadcast(known), "doc_id")
    # one text for each identifier, however many rows have it
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", most: int = MOST_ROWS) -> AdditiveModel:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = np.concatenate([features(texts[a:b]) for a, b in chunks(texts)]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), *(pa.array(rows[:, j]) for j in range(rows.shape[1]))], ["doc_id", "y", *FEATURES])

    found = labelled(docs, labels, label, allowed, most).mapInArrow(lean(work), "doc_id string, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    found = found.sort_values(["doc_id", *FEATURES]).drop_duplicates("doc_id")[:most]
    return AdditiveModel(found[FEATURES].to_numpy(float), (found["y"].to_numpy(float) > 0).astype(float))


def scored(docs: DataFrame, model: AdditiveModel, threshold: float, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [sent.value.score(features(texts[a:b])) for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = slim(docs).mapInArrow(lean(work), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
