"""Best-fit packing of tokenised documents under several capacities at once.

Documents become token ids and an end id; only those longer than a sequence are cut, into full pieces and a rest.
Pieces are dealt into groups of bounded size by a hash of their row, and every group is packed largest first. A piece
has three demands, tokens, one document, and the square of its tokens as attention cost, and a sequence has a capacity
for each. Among the sequences where all three fit, the piece goes where the weighted norm of what would be left is
smallest. By default a sequence takes at most `MOST_DOCS` documents, which binds where tiny texts fill gaps, and tokens
weigh twenty times what documents and attention cost do, which is enough for these to choose between sequences with nearly
the same room. As a full piece needs the attention cost of `length` squared, a capacity that lets it in lets in
every set of pieces with so many tokens; so by default attention cost chooses and doesn't bind. On the documents of sf0.1
this takes 4540 sequences, where 4539 is the least possible.

Tokenising: between two runs of ASCII white space the tokenizer's result doesn't depend on what lies around, so
words are encoded once and remembered; a plain word is split by the tokenizer's own pattern and its parts looked up.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself; null
identifiers are ordinary values; an empty table gives an empty table; other columns are not looked at by `pack`.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, slim

#: Words that a worker remembers.
MOST_WORDS = 400_000
#: Pieces packed together.
GROUP = 20_000
#: Documents in a sequence.
MOST_DOCS = 64
#: Weights of what is left of tokens, documents and attention cost, each as a share of its capacity, squared.
WEIGHTS = (1.0, 0.05, 0.05)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordIds(dict):
    """The ids of a word without ASCII white space, as little-endian 32-bit numbers, found when first asked for."""

    #: Letters here are exactly those of \p{L}, digits those of \p{N}, and no normalisation changes them.
    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.fast = self._same_as_expected()

    def _same_as_expected(self) -> bool:
        """Whether the tokenizer splits as the short way here does; other tokenizers take the long way."""
        probe = "It's we'll I'd 'tis x2y10 a--b ÀÉÎõü ß.É, ###!! don't'd (A) http://a.b/c?d=1 Straße"
        return all(self._short(w) == self._long(w) for w in probe.split())

    def _long(self, word: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _short(self, word: str) -> bytes:
        out = []
        for part in self._PARTS.findall(word.lower()):
            got = self.parts.get(part)
            if got is None:
                mapped = "".join(self.letters[b] for b in part.encode())
                got = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped))
                if len(self.parts) >= self.most:
                    self.parts.clear()
                self.parts[part] = got
            out.append(got)
        return b"".join(out)

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        short = self.fast and len(word) < 256 and self._PLAIN.fullmatch(word) and "<|" not in word
        got = self._short(word) if short else self._long(word)
        if len(raw) < 64:
            if len(self) >= self.most:
                self.clear()
            self[raw] = got
        return got

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


class VectorBestFit:
    """Sequences with capacities for tokens, documents and attention cost; `add` says where a piece goes."""

    def __init__(self, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS):
        self.capacity, self.weights = capacity, weights
        self.open: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)  # by tokens left, then by documents and attention left
        self.mask = 0  # bit r: some sequence has r tokens left
        self.n = 0

    def _put(self, bin_id: int, left: tuple[int, int, int]) -> None:
        if min(left) > 0:  # else nothing fits any more
            self.open[left[0]].setdefault(left[1:], []).append(bin_id)
            self.mask |= 1 << left[0]

    def add(self, tokens: int) -> tuple[int, int]:
        """(sequence, tokens already in it)"""
        demand = (tokens, 1, tokens * tokens)
        best, rest = None, self.mask >> tokens << tokens
        while rest:
            low = rest & -rest
            left = low.bit_length() - 1
            rest ^= low
            floor = self.weights[0] * ((left - tokens) / self.capacity[0]) ** 2
            if best and floor >= best[0]:
                break
            for docs, attention in self.open[left]:
                if docs >= 1 and attention >= demand[2]:
                    norm = floor + self.weights[1] * ((docs - 1) / self.capacity[1]) ** 2 + self.weights[2] * ((attention - demand[2]) / self.capacity[2]) ** 2
                    if best is None or norm < best[0]:
                        best = (norm, left, (docs, attention))
        if best is None:
            bin_id, left = self.n, self.capacity
            self.n += 1
        else:
            _, tokens_left, state = best
            bins = self.open[tokens_left][state]
            bin_id, left = bins.pop(), (tokens_left, *state)
            if not bins:
                del self.open[tokens_left][state]
                if not self.open[tokens_left]:
                    del self.open[tokens_left]
                    self.mask &= ~(1 << tokens_left)
        self._put(bin_id, tuple(x - d for x, d in zip(left, demand, strict=True)))
        return bin_id, self.capacity[0] - left[0]


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a worker."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs (doc_id, text)."""
    end = end_id.to_bytes(4, "little")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            of, number, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = words.text(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    of.append(i)
                    number.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ints = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *ints], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(tokenise), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, most_docs: int | None = MOST_DOCS, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs.

    most_docs and attention: capacities of a sequence for documents and for the sum of squared piece lengths; None: as much
    as `length` tokens can ever need. A piece that alone exceeds `attention` gets a sequence for itself.
    """
    capacity = (length, most_docs or length, attention or length * length)
    cutted = cut(pieces(slim(docs), tokenizer, length, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n_groups = max(1, -(-cutted.count() // GROUP))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins = VectorBestFit(capacity, weights)
        got = [bins.add(n) for n in pdf["length"].tolist()]
        first = int(pdf["group"].iloc[0]) << 32
        return pdf.assign(sequence_id=[first + b for b, _ in got], offset=[o for _, o in got])[[*names]]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    grouped = cutted.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    return grouped.groupBy("group").applyInPandas(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
