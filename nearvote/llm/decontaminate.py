"""Benchmark decontamination with suffix arrays over the training texts.

Documents go into shards of a few megabytes. A shard's suffix array holds the place of every word, sorted by the words
that follow it, as deep as a window: words are numbered in the order of their hashes, several numbers make one sort key, and
only places that tie are sorted on by the next ones. Every test suffix is found by binary search, which gives all its
occurrences as one interval of the array; occurrences that can't be extended to the left are extended to the right by
comparing words, which gives the longest verbatim matches and where they are. Words of equal hash are compared byte by byte.

The benchmark goes to the workers in blocks of bounded size. A shard's array is built once for all blocks of a pass, and a pass takes
`PASS_BYTES` of benchmark; further passes return rows for the documents they hit and nothing else.

Words: A-Z as a-z, then runs of ASCII letters, digits and everything not ASCII. Defined results: a null or empty text
has no words, no hits and stays; a null item identifier counts as the empty one; rows of one item identifier
are one item; repeated documents are each judged; an empty benchmark hits nothing; other columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, sealed, slim
from .text import ALNUM, Words, chunks

#: Words of a test item in a row that make a hit.
WINDOW = 10
#: Bytes of benchmark text in a block, and in the blocks of a pass over the documents.
BLOCK_BYTES, PASS_BYTES = 16 << 20, 128 << 20
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20


class TestSuffixes:
    """The words of a block of items, and for each window length its different windows, each with its (item, place) pairs."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        words = Words([text for _, text in items], ALNUM)
        self.hashes, self.first, self.last = words.hashes, words.first, words.last
        self.vocabulary, at = np.unique(words.hashes, return_index=True)
        self.letters = [words.word(i).lower() for i in at]
        self.numbers = np.searchsorted(self.vocabulary, words.hashes)
        places: dict[int, list[np.ndarray]] = {}
        who: dict[int, list[np.ndarray]] = {}
        for i, (name, _) in enumerate(items):
            n = int(words.counts[i])
            if n:
                size = min(n, window)
                places.setdefault(size, []).append(np.arange(words.first[i], words.last[i] - size + 1))
                who.setdefault(size, []).append(np.full(n - size + 1, number[name]))
        #: size, one place of each different window, and where its pairs begin in: owners, places
        self.by_size = []
        for size in sorted(places):
            place, owner = np.concatenate(places[size]), np.concatenate(who[size])
            windows = np.ascontiguousarray(self.hashes[place[:, None] + np.arange(size)]).view(f"V{8 * size}").ravel()
            _, one, inverse = np.unique(windows, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            bounds = np.searchsorted(inverse[order], np.arange(len(one) + 1))
            self.by_size.append((size, place[one], bounds, owner[order], place[order]))


class SuffixArray:
    """The places of all words of a shard's texts, sorted by the words that follow, `depth` of them at least."""

    def __init__(self, texts: list[str | None], depth: int):
        self.words = words = Words(texts, ALNUM)
        self.vocabulary, self.one, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        # a 0 after each text ends all matches
        n, self.text = len(words.hashes), words.text_of()
        self.place = np.arange(n) + self.text
        self.numbers = np.zeros(n + len(texts) + 2 * depth + 64, np.int64)
        self.numbers[self.place] = number + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.step = min(depth, 63 // self.bits)
        key = self._key(self.place, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.first_keys = key
        self.order = self.place[order]
        tied = np.arange(n)
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) if n else tied
        for level in range(1, -(-depth // self.step)):
            # only places that tie so far are sorted on
            many = np.bincount(group)[group] > 1
            tied, group = tied[many], group[many]
            if not len(tied):
                break
            key = self._key(self.order[tied], level)
            by = np.lexsort((key, group))
            self.order[tied] = self.order[tied[by]]
            key, group = key[by], group[by]
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))

    def _key(self, at: np.ndarray, level: int) -> np.ndarray:
        """The numbers of the `step` words from level * step on, in one."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.step):
            out = (out << self.bits) | self.numbers[at + level * self.step + k]
        return out

    def numbers_of(self, suffixes: TestSuffixes) -> np.ndarray:
        """For each word of the vocabulary of suffixes its number here, -1 if it isn't here."""
        at = np.searchsorted(self.vocabulary, suffixes.vocabulary)
        there = np.flatnonzero(at < len(self.vocabulary))
        there = there[self.vocabulary[at[there]] == suffixes.vocabulary[there]]
        there = np.array([i for i in there.tolist() if self.words.word(self.one[at[i]]).lower() == suffixes.letters[i]], np.int64)
        out = np.full(len(at), -1)
        out[there] = at[there] + 1
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """wanted: a row of word numbers for each suffix; the interval of the array that begins with it."""
        size = wanted.shape[1]
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order))
        for level in range(-(-size // self.step)):
            part = wanted[:, level * self.step : (level + 1) * self.step]
            least = np.zeros(len(wanted), np.int64)
            for k in range(part.shape[1]):
                least = (least << self.bits) | part[:, k]
            least <<= self.bits * (self.step - part.shape[1])
            most = least + (np.int64(1) << (self.bits * (self.step - part.shape[1])))
            if level:
                low, high = self._bisect(least, low, high, level), self._bisect(most, low, high, level)
            else:
                low, high = np.searchsorted(self.first_keys, least), np.searchsorted(self.first_keys, most)
        return low, high

    def _bisect(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (some := np.flatnonzero(low < high)).size:
            middle = (low[some] + high[some]) // 2
            less = self._key(self.order[middle], level) < key[some]
            low[some] = np.where(less, middle + 1, low[some])
            high[some] = np.where(less, high[some], middle)
        return low

    def occurrences(self, suffixes: TestSuffixes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length: its index in by_size, the length, the places of hits and the number of the window there, and the words' numbers."""
        here = self.numbers_of(suffixes)[suffixes.numbers]
        for k, (size, one, *_) in enumerate(suffixes.by_size):
            wanted = here[one[:, None] + np.arange(size)]
            known = np.flatnonzero((wanted >= 0).all(axis=1))
            low, high = self.find(wanted[known])
            at, window = _ranges(low, high)
            if len(at):
                yield k, size, self.order[at], known[window], here


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to high, and of which range each is."""
    n = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(n)), n)
    return low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def _text_at(array: SuffixArray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place and the number of the word there, from the text's first."""
    text = array.text[np.searchsorted(array.place, place)]
    return text, place - text - array.words.first[text]


def hits(array: SuffixArray, blocks: Iterator[TestSuffixes]) -> tuple[list[list[int]], list[list[str]]]:
    """For each text: the spans of its hit words (first, end, first, end ...), the items that hit it."""
    n = len(array.words.counts)
    change = np.zeros(len(array.numbers) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(n)]
    for suffixes in blocks:
        for k, size, at, window, _ in array.occurrences(suffixes):
            _, _, bounds, owner, _ = suffixes.by_size[k]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            text, window = np.unique(np.stack([_text_at(array, at)[0], window]), axis=1)
            pair, of = _ranges(bounds[window], bounds[window + 1])
            for d, i in np.unique(np.stack([text[of], owner[pair]]), axis=1).T.tolist():
                items[d].add(suffixes.names[i])
    spans: list[list[int]] = [[] for _ in range(n)]
    covered = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0))
    if len(edges):  # the 0 after each text is never covered
        begin, end = edges[::2], edges[1::2]
        text, first = _text_at(array, begin)
        for d, s, e in zip(text.tolist(), first.tolist(), (first + end - begin).tolist(), strict=True):
            spans[d] += (s, e)
    return spans, [sorted(x) for x in items]


def matches(array: SuffixArray, suffixes: TestSuffixes) -> list[tuple[int, str, int, int, int]]:
    """(text, item, first word in the text, in the item, number of words) of the longest verbatim matches."""
    out = []
    for k, size, at, window, here in array.occurrences(suffixes):
        _, _, bounds, owner, place = suffixes.by_size[k]
        pair, of = _ranges(bounds[window], bounds[window + 1])
        p, t, who = at[of], place[pair], owner[pair]
        item = np.searchsorted(suffixes.first, t, "right") - 1
        before = (t > suffixes.first[item]) & (p > 0)
        before[before] = array.numbers[p[before] - 1] == here[t[before] - 1]
        p, t, who, item = p[~before], t[~before], who[~before], item[~before]
        length, on = np.full(len(p), size), np.arange(len(p))
        while len(on):
            on = on[t[on] + length[on] < suffixes.last[item[on]]]
            on = on[array.numbers[p[on] + length[on]] == here[t[on] + length[on]]]
            length[on] += 1
        text, first = _text_at(array, p)
        out += [(d, suffixes.names[i], f, j, m) for d, i, f, j, m in zip(text.tolist(), who.tolist(), first.tolist(), (t - suffixes.first[item]).tolist(), length.tolist(), strict=True)]
    return out


def _passes(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[list[Broadcast]]:
    """Blocks of the benchmark, those of one pass together."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, most = max(1, -(-size // BLOCK_BYTES)), max(1, PASS_BYTES // BLOCK_BYTES)
    sc = benchmark.sparkSession.sparkContext
    for begin in range(0, n, most):
        blocks = []
        for b in range(begin, min(n, begin + most)):
            block = TestSuffixes([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).collect()], window)
            blocks.append(sc.broadcast(block))
        yield blocks


def _arrays(texts: list[str | None], window: int) -> Iterator[tuple[int, SuffixArray]]:
    for a, b in chunks(texts, SHARD_BYTES):
        yield a, SuffixArray(texts[a:b], window)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with __n_words, __spans (hit words: first, end, first, end ...) and __items (identifiers of the items that hit); docs has no columns of these names."""
    at, plain = docs.columns.index(text_col), docs.columns
    added = [T.StructField("__n_words", T.LongType()), T.StructField("__spans", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]

    def searched(rows: DataFrame, blocks: list[Broadcast], at: int, all_rows: bool) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = [], [], []
                for _, array in _arrays(batch.column(at).to_pylist(), window):
                    found = hits(array, (b.value for b in blocks))
                    n_words += array.words.counts.tolist()
                    spans += found[0]
                    items += found[1]
                more = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in added)])
                yield out if all_rows else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

        return rows.mapInArrow(lean(search), T.StructType([*rows.schema.fields, *added]))

    first, *others = _passes(benchmark, window, item_col, item_text_col)
    out = searched(docs, first, at, True)
    if not others:
        return out
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(text), F.hash(text), F.octet_length(text)]
    names = [f"__key{k}" for k in range(len(key))]
    more = None
    for blocks in others:
        part = searched(docs.select(*(k.alias(c) for k, c in zip(key, names, strict=True)), text.alias("__text")), blocks, len(key), False).select(*names, "__spans", "__items")
        more = part if more is None else more.unionByName(part)
    # equal texts have equal hits, so one row of each is enough
    one = F.row_number().over(Window.partitionBy(*names, "__spans", "__items").orderBy(F.lit(1)))
    more = more.withColumn("__one", one).where("__one = 1").groupBy(*names).agg(F.flatten(F.collect_list("__spans")).alias("__spans2"), F.flatten(F.collect_list("__items")).alias("__items2"))
    both = out.withColumns(dict(zip(names, key, strict=True))).join(more, names, "left")
    joined = lambda c: F.when(F.col(f"{c}2").isNull(), F.col(c)).otherwise(F.concat(c, f"{c}2")).alias(c)
    return both.select(*plain, "__n_words", joined("__spans"), joined("__items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    marked = mark(slim(docs), benchmark, window).drop("text")
    items = F.array_sort(F.array_distinct("__items"))
    # spans of several passes can overlap
    ends = F.transform(F.expr("sequence(0, cast(size(__spans) div 2 as int) - 1)"), lambda i: F.struct(F.get("__spans", 2 * i).alias("s"), F.get("__spans", 2 * i + 1).alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(x.s, acc.upto))).cast("long").alias("n"), F.greatest(acc.upto, x.e).alias("upto"))
    n_hit = F.when(F.size("__spans") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.array_sort(ends), zero, step, lambda acc: acc.n))
    return marked.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words: the longest verbatim matches, in words, and where they are."""
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in names[2:])])
    out = None
    for blocks in _passes(benchmark, window, "item_id", "text"):

        def search(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, array in _arrays(batch.column(1).to_pylist(), window):
                    found = [m for b in blocks for m in matches(array, b.value)]
                    ids = batch.column(0).take(pa.array([a + m[0] for m in found], pa.int64()))
                    rest = [pa.array([m[1] for m in found], pa.string()), *(pa.array([m[k] for m in found], pa.int64()) for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names)

        part = slim(docs).mapInArrow(lean(search), schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs without any hit word, with the columns of docs."""
    text_col = f"col{docs.columns.index(text_col)}"
    docs, names = sealed(docs)
    return mark(docs, benchmark, window, text_col).where(F.size("__spans") == 0).select(docs.columns).toDF(*names)
