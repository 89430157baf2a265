"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

Base patterns give spans of e-mail addresses, IP addresses, card and phone numbers. The field works on the tokens
between white space that hold a digit or an @. Neighbouring tokens form chains; tokens elsewhere in the document that
have the same or a similar value (the same address, the same last seven digits, also of digits in spaced groups) are joined by
skip edges to the first of them, so that evidence for one mention counts for the others. Tokens inside base spans are observed. Loopy sum-product message
passing over both kinds of edges gives each other token's label; tokens of one label in a row become a span.

The weights are trained on generated sentences by pseudo-likelihood, in numpy, with a fixed seed.
Tokens without digit or @ are taken to be no personal data, which ends a chain.

Defined results: a null text is empty and has no spans; repeated rows get equal results; an empty table gives an empty
table; other columns are not looked at by `find` and kept by `mask`. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, slim

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
#: Rounds of message passing at most, the weight of the old message in each, and the change below which messages have settled.
ROUNDS, DAMPING, SETTLED = 60, 0.3, 1e-4
#: Digits of a run of digit groups that count as one value.
MOST_DIGITS = 19
#: A token is added from this marginal probability on.
AT_LEAST = 0.8

# the base patterns; the guards before them only skip places where no leftmost match can begin
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    if not _ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


# --- the field

_OPEN, _CLOSE = "\"'<[{,;:", "\"'>]},.;:!?"


class Token:
    """A token that holds a digit or an @: its core, features and skip key. chained: only white space since the last one."""

    __slots__ = ("chained", "end", "features", "key", "shape", "start", "text")

    def __init__(self, text: str, start: int, chained: bool):
        core = text.lstrip(_OPEN)
        start += len(text) - len(core)
        core = core.rstrip(_CLOSE)
        self.text, self.start, self.end, self.chained = core, start, start + len(core), chained
        d = _digits(core)
        low = core.lower()
        self.key = low if "@" in core else d[-7:] if len(d) >= 7 else None
        self.shape = _shape(core, d)


_SHAPES = [
    ("mail", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")),
    ("at", re.compile(r".*@.*", re.S)),
    ("quad", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?")),
    ("country", re.compile(r"\+[0-9]{1,3}")),
    ("intl", re.compile(r"\+[0-9().-]{8,}")),
    ("area", re.compile(r"\([0-9]{2,4}\)")),
    ("local7", re.compile(r"[0-9]{3}[.-][0-9]{4}")),
    ("national", re.compile(r"\(?[0-9]{3}[).-]*[0-9]{3}[.-][0-9]{4}")),
    ("date", re.compile(r"[0-9]{1,4}([/.-])[0-9]{1,2}\1[0-9]{1,4}")),
    ("time", re.compile(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?")),
    ("four", re.compile(r"[0-9]{4}")),
    ("cards", re.compile(r"[0-9]{4}([.-][0-9]{4}){3}")),
    ("short", re.compile(r"[0-9]{1,3}")),
    ("digits", re.compile(r"[0-9]+")),
    ("amount", re.compile(r"[0-9.,]+[%$€]?")),
    ("mixed", re.compile(r"[\w-]+")),
]


def _shape(core: str, digits: str) -> str:
    if len(core) > 64:
        return "long"
    for name, pattern in _SHAPES:
        if pattern.fullmatch(core):
            if name in ("digits", "cards"):
                n = len(digits)
                return f"digits{'12+' if 12 <= n <= 19 else '10' if 9 <= n <= 11 else '5' if n < 9 else '20'}{'luhn' if 12 <= n <= 19 and luhn(digits) else ''}"
            return name
    return "other"


_NAMES = [name for name, _ in _SHAPES if name not in ("digits", "cards")] + ["digits5", "digits10", "digits12+", "digits12+luhn", "digits20", "long", "other", "edge"]
_NUMBER = {name: i for i, name in enumerate(_NAMES)}


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    last = -1
    for m in _ANY.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        floor = max(last, 0)
        while start > floor and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, start).end()
        out.append(Token(text[start:end], start, bool(out) and last >= 0 and not text[last:start].strip()))
        last = end
    return out


def _features(seq: list[Token]) -> np.ndarray:
    """Shapes of each token and of its neighbours in the chain, one-hot."""
    n, k = len(seq), len(_NAMES)
    shape = np.array([_NUMBER[t.shape] for t in seq])
    chained = np.array([t.chained for t in seq])
    before = np.where(chained, np.roll(shape, 1), _NUMBER["edge"])
    after = np.where(np.roll(chained, -1) & (np.arange(n) < n - 1), np.roll(shape, -1), _NUMBER["edge"])
    out = np.zeros((n, 3 * k))
    rows = np.arange(n)
    out[rows, shape] = out[rows, k + before] = out[rows, 2 * k + after] = 1
    return out


_GROUPED = frozenset("0123456789+().-")


def _keys(seq: list[Token]) -> list[str | None]:
    """The skip key of each token: its own, or that of the run of digit groups it is part of, with only white space between."""
    out = [t.key for t in seq]
    begin = 0
    while begin < len(seq):
        end = begin
        while end < len(seq) and (end == begin or seq[end].chained) and _GROUPED.issuperset(seq[end].text):
            end += 1
        if end - begin > 1:
            joint = _digits("".join(t.text for t in seq[begin:end]))
            if 7 <= len(joint) <= MOST_DIGITS:
                out[begin:end] = [key or joint[-7:] for key in out[begin:end]]
        begin = max(end, begin + 1)
    return out


def _edges(seq: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges and skip edges; of several tokens with one key each is joined with the first, so that two are at most two edges apart."""
    chain = [(i - 1, i) for i, t in enumerate(seq) if t.chained and i]
    seen: dict[str, int] = {}
    skip = []
    for i, key in enumerate(_keys(seq)):
        if key is not None:
            if key in seen:
                skip.append((seen[key], i))
            else:
                seen[key] = i
    return np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)


class Field:
    """unary: label scores of features; chain, skip: scores of the labels at both ends of an edge."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, seq: list[Token], observed: np.ndarray) -> np.ndarray:
        """observed: the label of each token, -1 where it is to be found."""
        score = _features(seq) @ self.unary
        known = np.flatnonzero(observed >= 0)
        score[known] = -50
        score[known, observed[known]] = 0
        chain, skip = _edges(seq)
        ends = np.concatenate([chain, skip])
        if not len(ends):
            return _softmax(score)
        # both directions of every edge
        a, b = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        forward = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        pair = np.exp(np.concatenate([forward, forward.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(a), len(LABELS)))
        for _ in range(ROUNDS):
            total = score.copy()
            np.add.at(total, b, message)
            out = _softmax(total[a] - message[back])
            new = np.log(np.einsum("ei,eij->ej", out, pair) + 1e-30)
            new -= new.max(1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved, message = np.abs(np.exp(new) - np.exp(message)).max(), new
            if moved < SETTLED:
                break
        total = score.copy()
        np.add.at(total, b, message)
        return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sentence(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its entities as (start, end, label)."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def noise() -> str:
        return pick(word(), word(), word(), word(), num(1), num(2), num(3), num(4), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(1)}", f"{num(2)},{num(3)}", num(int(rng.integers(5, 26))), f"{word()}{num(3)}", f"{num(6)}{word()}{num(5)}", f"{num(3)}-{num(4)}-{num(2)}", f"{num(8)}-{num(4)}", f"@{word()}", f"{num(4)} {num(4)}", f"{num(3)} {num(3)}")

    def entity() -> tuple[int, list[str]]:
        kind = int(rng.integers(1, 5))
        if kind == 1:
            mail = f"{word()}{pick('.', '_', '')}{num(2)}@{word()}.{pick('com', 'org', 'example.com')}"
            return kind, [mail, mail.upper(), mail.capitalize()]
        if kind == 2:
            ip = ".".join(str(x) for x in rng.integers(0, 256, 4))
            return kind, [ip, f"{ip}:{num(4)}"]
        if kind == 3:
            d = num(15)
            d += next(c for c in "0123456789" if luhn(d + c))
            return kind, [d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))]
        a, b, c = num(3), num(3), num(4)
        return kind, [f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]

    parts, text, spans = [], "", []
    for _ in range(rng.integers(1, 4)):
        kind, forms = entity()
        parts += [(kind, pick(*forms)) for _ in range(rng.integers(1, 4))]
    parts += [(0, noise()) for _ in range(rng.integers(6, 24))]
    for i in rng.permutation(len(parts)):
        kind, form = parts[i]
        form = pick("", "", "", "(" if kind == 0 else "", '"') + form
        at = len(text)
        text += form + pick("", "", "", ".", ",") + " "
        if kind:
            spans.append((at, at + len(form), kind))
        if rng.random() < 0.6:
            text += word() + " "
    return text, spans


@cache
def trained(seed: int = 7, sentences: int = 500, steps: int = 150) -> Field:
    """Weights by gradient ascent on the pseudo-likelihood: each label given those at the other ends of its edges."""
    rng = np.random.default_rng(seed)
    feats, gold, chains, skips, n = [], [], [], [], 0
    for _ in range(sentences):
        text, spans = _sentence(rng)
        seq = tokens(text)
        if not seq:
            continue
        feats.append(_features(seq))
        gold += [next((k for s, e, k in spans if t.start < e and s < t.end), 0) for t in seq]
        chain, skip = _edges(seq)
        chains.append(chain + n)
        skips.append(skip + n)
        n += len(seq)
    x, y = np.concatenate(feats), np.eye(len(LABELS))[gold]
    chain, skip = np.concatenate(chains), np.concatenate(skips)
    unary, c, s = np.zeros((x.shape[1], len(LABELS))), np.zeros((len(LABELS),) * 2), np.zeros((len(LABELS),) * 2)
    rate = 8.0
    for _ in range(steps):
        score = x @ unary
        for ends, w in ((chain, c), (skip, s)):
            np.add.at(score, ends[:, 1], y[ends[:, 0]] @ w)
            np.add.at(score, ends[:, 0], y[ends[:, 1]] @ w.T)
        gap = (y - _softmax(score)) / n
        unary += rate * (x.T @ gap - 1e-4 * unary)
        for ends, w in ((chain, c), (skip, s)):
            w += rate * (y[ends[:, 0]].T @ gap[ends[:, 1]] + gap[ends[:, 0]].T @ y[ends[:, 1]] - 1e-4 * w)
    return Field(unary, c, s)


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    seq = tokens(text) if base or _ANY.search(text) else []
    if not seq:
        return base, base
    observed = np.full(len(seq), -1)
    k = 0
    ordered = sorted(base)
    for i, t in enumerate(seq):
        while k < len(ordered) and ordered[k][1] <= t.start:
            k += 1
        for s, e, kind in ordered[k : k + 4]:
            if s < t.end and t.start < e and observed[i] < 0:
                observed[i] = LABELS.index(kind)
    if (observed >= 0).all():
        return base, base
    p = field.marginals(seq, observed)
    label = p.argmax(1)
    add: list[tuple[int, int, str]] = []
    joined = False
    for i, t in enumerate(seq):
        if observed[i] < 0 and label[i] and p[i, label[i]] >= AT_LEAST and t.end > t.start:
            kind = LABELS[label[i]]
            if joined and t.chained and add[-1][2] == kind:
                add[-1] = (add[-1][0], t.end, kind)
            else:
                add.append((t.start, t.end, kind))
            joined = True
        else:
            joined = False
    return base, sorted(base + add, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _line(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            found = [spans(t or "", field) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[2] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_line(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([_line(x) for _, x in found], pa.string())
            added = pa.array([len(x) - len(base) for base, x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, every, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim(docs).mapInArrow(lean(work), f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; overlapping spans become one."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def masked(text: str | None, field: Field) -> str | None:
        found = spans(text, field)[1] if text else []
        out, end = [], 0
        for s, e, kind in found:
            if s >= end:
                out += [text[end:s], f"[{kind}]"]
            end = max(end, e)
        return "".join([*out, text[end:]]) if found else text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t, field) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(lean(work), T.StructType(docs.schema.fields))
