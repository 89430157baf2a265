"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the embedding of its hash together with the pooled embeddings of its five-byte grams (character
inputs: stems and endings of words never seen whole). Two recurrent passes, forward and backward, read each window of
`WINDOW` words; attention pools the states into one vector and a linear unit gives the window's score. Windows
overlap by half and all are scored; a text is as toxic as its worst window.

Training: texts have labels, windows don't, so in every epoch each text's worst window is taken for it, and for
harmless texts another one besides. Embeddings start from how surely words and grams speak for toxic training texts; all
weights then learn by Adam, embeddings slowly, lest they learn single texts by heart. At most `MOST_ROWS` labelled rows are used, those with the smallest hash of
the identifier, and of these, in order of identifiers, the ones whose texts fit into `MOST_BYTES` together: a longer text is left out whole. Training is one
task of an executor; only the weights come to the driver.

Defined results: a null or empty text or one without words scores like the least toxic text; repeated rows get equal
scores; rows with a null identifier are scored and never learned from; labels are the largest for an identifier; without
both labels in the training rows all scores are the share of toxic ones; an empty table gives an empty table; other
columns are not looked at by `scored` and kept by `remove_toxic`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, lean, slim
from .quality import labelled
from .text import ALNUM, Words, chunks, mix, powers

MOST_ROWS, MOST_BYTES = 5_000, 24 << 20
WINDOW, STRIDE = 32, 16
#: Windows that go through the network together, and bytes of training texts kept as one part.
TOGETHER, PART_BYTES = 4096, 1 << 19
BITS, WIDTH, HIDDEN, GRAM = 17, 4, 8, 5
EPOCHS, BATCH, RATE, TABLE_RATE = 4, 256, 0.01, 0.1
_MASK = np.uint64((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Vocabulary:
    """The different words of a chunk of texts: bucket of each and the buckets of its grams, and the words in order."""

    def __init__(self, texts: list[str | None]):
        w = self.words = Words(texts, ALNUM)
        self.hashes, at, self.index = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.bucket = (self.hashes & _MASK).astype(np.int64)
        # grams of ^word$, letters in lower case, of this chunk's different words only
        start, size = w.starts[at], (w.ends - w.starts)[at]
        length = size + 2
        first = np.cumsum(length) - length
        inner = np.arange(length.sum()) - np.repeat(first, length)
        codes = np.frombuffer(w.data, np.uint8)
        letters = ALNUM[codes[np.repeat(start, length) + np.clip(inner - 1, 0, np.repeat(size, length) - 1)]]
        letters[first] = 0x1F123BB5
        letters[first + length - 1] = 0x2545F491
        m = 0xD1342543DE82EF95
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers(m, len(letters)), dtype=np.uint64)])
        n = np.minimum(GRAM, length)
        count = length - n + 1
        self.gram_first = np.cumsum(count) - count
        place = np.repeat(first - self.gram_first, count) + np.arange(count.sum())
        span = np.repeat(n, count)
        grams = mix((total[place + span] - total[place]) * powers(pow(m, -1, 1 << 64), len(letters) + 1)[place])
        self.gram_count, self.grams = count, (grams & _MASK).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of each window (the number of words stands for none), and each window's text."""
        w, n = self.words, self.words.counts
        steps = np.where(n == 0, 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1)
        text = np.repeat(np.arange(len(n)), steps)
        k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        start = w.first[text] + np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW))
        at = start[:, None] + np.arange(WINDOW)
        inside = at < w.last[text][:, None]
        return np.where(inside, self.index[np.minimum(at, max(len(self.index) - 1, 0))], len(self.hashes)), text


class Network:
    """words, grams: embedding tables; gates: input, state and bias weights of each direction; attention and output."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, prior: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"words": words, "grams": grams, "v": draw(2 * HIDDEN, HIDDEN), "u": draw(HIDDEN), "o": draw(2 * HIDDEN), "b": np.array([prior], np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * WIDTH, 3 * HIDDEN), f"r{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.constant: float | None = None
        self.shift = 0.0
        self.scale = 1.0

    @classmethod
    def constantly(cls, share: float) -> Network:
        """Gives all texts one score."""
        net = cls(*(np.zeros((1, WIDTH), np.float32) for _ in range(2)), prior=0.0)
        net.constant = share
        return net

    def inputs(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """A row for each different word and one of zeros; the gram that gave each pooled value."""
        p, v = self.p, vocabulary
        out = np.zeros((len(v.hashes) + 1, 2 * WIDTH), np.float32)
        if not len(v.hashes):
            return out, np.zeros((0, WIDTH), np.int64)
        out[:-1, :WIDTH] = p["words"][v.bucket]
        values = p["grams"][v.grams]
        out[:-1, WIDTH:] = np.maximum.reduceat(values, v.gram_first)
        return out, values

    def _pass(self, gates: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction: gates (time, batch, 3 x HIDDEN) are the inputs' share."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        saved = []
        r_, H = self.p[f"r{d}"], HIDDEN
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            g = gates[t]
            zr = _sigmoid(g[:, : 2 * H] + h @ r_[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            rh = r * h
            n = np.tanh(g[:, 2 * H :] + rh @ r_[:, 2 * H :])
            if keep:
                saved.append((t, h, z, r, rh, n))
            h = h + z * (n - h)
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """A score for each window; x: input rows."""
        p = self.p
        inside = (windows != len(x) - 1).T[:, :, None]
        states, saved = [], {}
        for d in "fb":
            gates = (x @ p[f"w{d}"] + p[f"c{d}"])[windows.T]
            s, saved[d] = self._pass(gates, d, keep)
            states.append(s)
        s = np.concatenate(states, axis=2)
        a = np.tanh(s @ p["v"])
        e = np.where(inside, (a @ p["u"])[:, :, None], -1e9)
        e = np.exp(e - e.max(0))
        e *= inside
        e /= np.maximum(e.sum(0), 1e-9)
        pooled = (e * s).sum(0)
        return pooled @ p["o"] + p["b"][0], {"saved": saved, "s": s, "a": a, "e": e, "pooled": pooled} if keep else {}

    def gradients(self, x: np.ndarray, values: np.ndarray, v: Vocabulary, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, H = self.p, HIDDEN
        score, k = self.forward(x, windows, keep=True)
        gap = ((_sigmoid(score) - y) * weight).astype(np.float32)
        g = {"o": k["pooled"].T @ gap, "b": np.array([gap.sum()], np.float32)}
        d_pooled = gap[:, None] * p["o"]
        s, a, e = k["s"], k["a"], k["e"]
        d_s = e * d_pooled
        d_e = (s * d_pooled).sum(2, keepdims=True)
        d_logit = (e * (d_e - (e * d_e).sum(0)))[:, :, 0]
        d_a = d_logit[:, :, None] * p["u"] * (1 - a * a)
        g["u"] = np.einsum("tb,tbh->h", d_logit, a)
        g["v"] = np.einsum("tbi,tbj->ij", s, d_a)
        d_s = d_s + d_a @ p["v"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            r_ = p[f"r{d}"]
            g_r, g_c, g_w = np.zeros_like(r_), np.zeros(3 * H, np.float32), np.zeros_like(p[f"w{d}"])
            d_h = np.zeros((windows.shape[0], H), np.float32)
            for t, h, z, r, rh, n in reversed(k["saved"][d]):
                d_h = d_h + d_s[t, :, i * H : (i + 1) * H]
                d_n = d_h * z * (1 - n * n)
                d_rh = d_n @ r_[:, 2 * H :].T
                d_zr = np.concatenate([d_h * (n - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
                g_r[:, : 2 * H] += h.T @ d_zr
                g_r[:, 2 * H :] += rh.T @ d_n
                gates = np.concatenate([d_zr, d_n], axis=1)
                g_c += gates.sum(0)
                g_w += x[windows[:, t]].T @ gates
                np.add.at(d_x, windows[:, t], gates @ p[f"w{d}"].T)
                d_h = d_h * (1 - z) + d_rh * r + d_zr @ r_[:, : 2 * H].T
            g |= {f"r{d}": g_r, f"c{d}": g_c, f"w{d}": g_w}
        used = np.unique(windows)
        used = used[used < len(x) - 1]
        rows, inverse = np.unique(v.bucket[used], return_inverse=True)
        full = np.zeros((len(rows), WIDTH), np.float32)
        np.add.at(full, inverse, d_x[used, :WIDTH])
        g["words"] = (rows, full)
        # every gram that gave a pooled value gets its gradient
        count = v.gram_count[used]
        at = np.repeat(v.gram_first[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        owner = np.repeat(used, count)
        k, j = np.nonzero(values[at] == x[owner, WIDTH:])
        rows, inverse = np.unique(v.grams[at[k]], return_inverse=True)
        full = np.zeros((len(rows), WIDTH), np.float32)
        np.add.at(full, (inverse, j), d_x[owner[k], WIDTH + j])
        g["grams"] = (rows, full)
        return g

    def window_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Vocabulary]:
        v = Vocabulary(texts)
        windows, text = v.windows()
        x, _ = self.inputs(v)
        parts = [self.forward(x, windows[i : i + TOGETHER])[0] for i in range(0, len(windows), TOGETHER)]
        return (np.concatenate(parts) if parts else np.zeros(0, np.float32)), windows, text, v

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        scores, _, text, _ = self.window_scores(texts)
        worst = np.full(len(texts), -20.0)
        np.maximum.at(worst, text, scores)
        return _sigmoid(worst.astype(float))


def _evidence(of: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each bucket how surely it speaks for toxic texts, from 0 to 3.

    That is the root of its likelihood ratio, less what the best of so many buckets would reach by chance, so that words
    which a few toxic texts happen to share count for nothing.
    """
    hits = np.zeros((2, 1 << BITS))
    for buckets, label in zip(of, y, strict=True):
        hits[int(label), np.unique(buckets)] += 1
    n, share = hits.sum(0), float(y.mean())
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(h > 0, h * np.log(h / (n * p)), 0.0) for h, p in ((hits[1], share), (hits[0], 1 - share))]
    ratio = np.where(hits[1] > n * share, 2 * (terms[0] + terms[1]), 0.0)
    return np.minimum(3.0, np.sqrt(np.maximum(0.0, ratio - 2 * np.log(max(1, (n > 0).sum())))) / 2)


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> Network:
    share = float((y.sum() + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(seed)
    # texts are kept as vocabularies of chunks, each with its range of texts
    parts = [(a, b, Vocabulary(texts[a:b])) for a, b in chunks(texts, PART_BYTES)]
    words, grams = [], []
    for _, _, v in parts:
        for i in range(len(v.words.counts)):
            own = np.unique(v.index[v.words.first[i] : v.words.last[i]])
            words.append(v.bucket[own])
            grams.append(np.concatenate([v.grams[v.gram_first[w] : v.gram_first[w] + v.gram_count[w]] for w in own]) if len(own) else np.zeros(0, np.int64))
    tables = []
    for of in (words, grams):
        table = (rng.standard_normal((1 << BITS, WIDTH)) * 0.02).astype(np.float32)
        if 0 < y.sum() < len(y):
            table[:, 0] = _evidence(of, y)
        tables.append(table)
    net = Network(*tables, prior=-2.0, seed=seed)
    if not 0 < y.sum() < len(y):
        net.constant = share
        return net
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    balance = float((y == 0).sum() / y.sum())
    # small training sets are gone through more often, for about as many steps
    for _ in range(EPOCHS * max(1, min(10, 2000 // len(texts)))):
        for a, b, v in [parts[i] for i in rng.permutation(len(parts))]:
            windows, text = v.windows()
            if not len(windows):
                continue
            x, _ = net.inputs(v)
            if step == 0:  # nothing is learned yet: the worst window is that of the strongest evidence
                scores = x[windows, 0].max(1) + x[windows, WIDTH].max(1)
            else:
                scores = np.concatenate([net.forward(x, windows[i : i + TOGETHER])[0] for i in range(0, len(windows), TOGETHER)])
            order = np.lexsort((-scores, text))
            worst = order[np.flatnonzero(np.concatenate([[True], text[order[1:]] != text[order[:-1]]]))]
            calm = np.flatnonzero(y[a:b][text] == 0)
            chosen = np.concatenate([worst, rng.choice(calm, min(len(calm), len(worst)), replace=False)])
            chosen = rng.permutation(chosen)
            for i in range(0, len(chosen), BATCH):
                pick = chosen[i : i + BATCH]
                x, values = net.inputs(v)
                target = y[a:b][text[pick]].astype(np.float32)
                weight = np.where(target > 0, min(balance, 10.0), 1.0).astype(np.float32) / len(pick)
                step += 1
                _adam(net, moments, net.gradients(x, values, v, windows[pick], target, weight), step)
    return net


def _adam(net: Network, moments: dict, gradients: dict, step: int) -> None:
    """One step; of the embedding tables only rows that have a gradient move."""
    for name, g in gradients.items():
        rows, g = g if isinstance(g, tuple) else (slice(None), g)
        m, v = moments[name]
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.999 * v[rows] + 0.001 * g * g
        rate = RATE * (TABLE_RATE if name in ("words", "grams") else 1.0)
        net.p[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-6)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Network:
    """A network learned from the labelled rows that `allowed` lets in: at most `most` of them, with texts of `most_bytes` in all."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, room, last = [], [], most_bytes, None
        for batch in batches:
            for name, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                size = len((text or "").encode("utf-8", "surrogatepass"))
                if len(texts) < most and name != last and size <= room:
                    texts.append(text)
                    y.append(int(toxic > 0))
                    room -= size
                last = name
        net = train(texts, np.array(y, int)) if texts else Network.constantly(0.5)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["network"])

    found = labelled(docs, labels, label, allowed, most).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y")
    # a row for each of `most` at most, so one task is enough
    with batches_of(docs.sparkSession, 200):
        got = found.repartition(1).sortWithinPartitions("doc_id", "text", "y").mapInArrow(lean(learn), "network binary").collect()
    return pickle.loads(got[0][0]) if got else Network.constantly(0.5)


def _scores(net: Network, texts: list[str | None]) -> np.ndarray:
    parts = [net.score(texts[a:b]) for a, b in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs: DataFrame, net: Network, threshold: float, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(sent.value, batch.column(1).to_pylist()))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = slim(docs).mapInArrow(lean(work), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, net: Network, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than threshold, with the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(lean(work), T.StructType(docs.schema.fields))
