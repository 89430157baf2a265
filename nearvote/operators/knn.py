"""Exact nearest neighbours without sorting or shuffling all pairs.

Vectors stay where they are: the queries, a stated set, go to every task in blocks of at most about MAX_QUERIES, and a task keeps the k
nearest of its vectors for each query. A task cuts its vectors into leaves of near ones with bounding boxes, and its queries likewise into
groups; a leaf is looked at unless its box is farther from the group's box than the k-th distance of every query in it, so no neighbour is
lost. Distances are matrix products of whole numbers in double precision: all terms and sums stay below 2 ** 53, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.functions.constants import K
from nearvote.functions.distance import l2

from .topk import top_k

#: Queries sent to every task at once; more are answered in blocks.
MAX_QUERIES = 400_000
#: Numbers in the vectors that a task holds at a time.
MOST_HELD = 1 << 23
#: Vectors of a leaf, queries of a group, and leaves whose distances are in memory at a time.
LEAF, GROUP, LEAVES = 128, 64, 32
#: Queries that share a box before each looks at leaves by itself.
FEW = 8
#: Pairs of a query and a vector up to which vectors are searched as they lie.
DENSE = 50_000_000_000
#: Rows of a batch of results.
OUT_ROWS = 1 << 16
_NONE = np.iinfo(np.int64).max


def _renamed(queries: DataFrame, dim: int) -> DataFrame:
    return queries.select(F.col("orig_id").alias("qid"), *(F.col(f"v{j}").alias(f"q{j}") for j in range(dim)))


def blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of about MAX_QUERIES at most."""
    n = -(-queries.count() // MAX_QUERIES)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("orig_id"), F.lit(n)) == b) for b in range(n)]


def distances(queries: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """qid, orig_id, is_fraud, dist for each query and vector, a block of queries after another."""
    pairs = lambda b: vectors.crossJoin(F.broadcast(_renamed(b, dim))).select("qid", "orig_id", "is_fraud", l2("q", "v", dim).alias("dist"))
    return reduce(DataFrame.unionByName, [pairs(b) for b in blocks(queries)])


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The columns of a batch as a matrix of doubles, a row for each row."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]) if batch.num_rows else np.zeros((0, len(names)))


def whole(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact."""
    return (queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1) - 2.0 * (queries @ vectors.T)


def single(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, added up dimension by dimension."""
    q, v = queries.astype(np.float32), vectors.astype(np.float32)
    out = np.zeros((len(q), len(v)), np.float32)
    for j in range(q.shape[1]):
        gap = q[:, j, None] - v[:, j]
        out += gap * gap
    return out


def nearer(low: np.ndarray, high: np.ndarray, leaves: Leaves) -> np.ndarray:
    """For each leaf the squared distance of its box from the box (low, high): no pair of points inside them is nearer, in either precision."""
    out = np.zeros(len(leaves.starts), leaves.low.dtype)
    for j in range(len(low)):
        gap = np.maximum(np.maximum(leaves.low[:, j] - high[j], low[j] - leaves.high[:, j]), 0)
        out += gap * gap
    return out


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes (or from one), in the precision of the points."""
    out = np.zeros(np.broadcast_shapes(points.shape[:-1], low.shape[:-1]), points.dtype)
    for j in range(points.shape[-1]):
        gap = np.maximum(points[..., j], low[..., j])
        np.minimum(gap, high[..., j], out=gap)  # the nearest place in the box
        np.subtract(points[..., j], gap, out=gap)
        gap *= gap
        out += gap
    return out


def between(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of the boxes (low, high), a row for each, from the boxes (lows, highs), a column for each."""
    out = np.zeros((len(low), len(lows)), lows.dtype)
    for j in range(low.shape[1]):
        gap = lows[:, j] - high[:, j, None]
        np.maximum(gap, low[:, j, None] - highs[:, j], out=gap)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def farther(low: np.ndarray, high: np.ndarray, leaves: Leaves) -> np.ndarray:
    """For each leaf the negative of the greatest squared distance that a point in its box can have from one in the box (low, high)."""
    gap = np.maximum(leaves.high - low, high - leaves.low)
    return -(gap * gap).sum(1)


def arranged(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which near ones lie together, and where its parts of at most `size` start; equal points keep their order."""
    # only the order depends on it; numpy sorts numbers of 16 bits by their digits
    points = np.ascontiguousarray(points, np.int16 if points.dtype == np.int16 else np.float32)
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        own, n, m = points[order[a:b]], b - a, (b - a) // 2
        j = int(own[:: max(1, n // 1024)].astype(np.float32).var(0).argmax())
        by = np.argsort(own[:, j], kind="stable")
        order[a:b], column = order[a:b][by], own[by, j]
        if column[m - 1] == column[m]:  # equal values stay together, unless that leaves next to nothing on one side
            left, right = np.searchsorted(column, column[m], "left"), np.searchsorted(column, column[m], "right")
            near = int(left if m - left <= right - m else right)
            m = near if n // 16 < near < n - n // 16 else m
        todo += [(a + m, b), (a, a + m)]
    return order, np.array(starts)


class Leaves:
    """Vectors cut into leaves, each with its bounding box and smallest identifier."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, measure=whole):
        order = np.argsort(ids, kind="stable")
        of, self.starts = arranged(vectors[order], LEAF)
        order = order[of]
        self.ends = np.append(self.starts[1:], len(order))
        self.ids, self.labels, dim = ids[order], labels[order], vectors.shape[1]
        if measure is single:
            self.vectors = vectors[order].astype(np.float32)
        else:  # |q - v|^2 = (-2 q, |q|^2, 1) . (v, 1, |v|^2): one product, each sum of it a whole number below 2 ** 53
            self.wide = np.ones((len(order), dim + 2))
            self.vectors = self.wide[:, :dim]
            self.vectors[:] = vectors[order]
            self.wide[:, -1] = np.einsum("ij,ij->i", self.vectors, self.vectors)
        # a dimension of all boxes lies together in memory
        self.low, self.high = (np.asfortranarray(f.reduceat(self.vectors, self.starts)) for f in (np.minimum, np.maximum))
        self.middle = (self.low + self.high) / 2
        self.first = np.minimum.reduceat(self.ids, self.starts)

    def boxes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of some leaves."""
        return np.take(self.low.T, which, axis=1).T, np.take(self.high.T, which, axis=1).T


class Nearest:
    """The k nearest so far of each query, in the order of (distance, identifier), and within its limit if there is one.

    Queries that follow one another ought to be near ones (`arranged`): GROUP of them are looked at together. With `far` it finds the farthest,
    by negative distances, in whole numbers.
    """

    def __init__(self, queries: np.ndarray, k: int, measure=whole, limit: np.ndarray | None = None, far: bool = False):
        self.queries, self.k, self.measure, self.far = queries, k, measure, far
        self.limit = np.full(len(queries), np.inf) if limit is None else limit.astype(np.float64)
        self.dist = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), _NONE)
        self.labels = np.zeros((len(queries), k), bool)

    def add(self, leaves: Leaves) -> None:
        for a in range(0, len(self.queries), GROUP):
            self._group(slice(a, min(a + GROUP, len(self.queries))), leaves)

    def _group(self, part: slice, leaves: Leaves) -> None:
        points = self.queries[part].astype(leaves.vectors.dtype)
        bounds = (farther if self.far else nearer)(points.min(0), points.max(0), leaves)
        wide = np.column_stack([-2.0 * points, (points * points).sum(1), np.ones(len(points))]) * (-1.0 if self.far else 1.0) if self.measure is whole else None

        def look(now: np.ndarray) -> None:
            rows = np.concatenate([np.arange(leaves.starts[i], leaves.ends[i]) for i in now])
            dist = wide @ leaves.wide[rows].T if self.measure is whole else self.measure(points, leaves.vectors[rows])
            self._merge(part.start, dist, leaves.ids[rows], leaves.labels[rows])

        todo, step = self._within(part, leaves, bounds, np.argsort(bounds, kind="stable")), 2
        if len(todo) > LEAVES and not self.far:  # each query's likeliest leaf gives it a bound; then the boxes of few queries and its own distances say more
            reach = np.minimum(self.dist[part, -1], self.limit[part])
            if np.isinf(reach).any():
                middle = leaves.middle[todo]
                likely = np.unique(((middle * middle).sum(1) - 2.0 * (points @ middle.T)).argmin(1))
                look(todo[likely])
                todo = self._within(part, leaves, bounds, np.delete(todo, likely))
                reach = np.minimum(self.dist[part, -1], self.limit[part])
            for size in (FEW, 1):
                if len(todo) > LEAVES:
                    at = np.arange(0, len(points), size)
                    own = between(np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), *leaves.boxes(todo))
                    own[own > np.maximum.reduceat(reach, at)[:, None]] = np.inf
                    bounds[todo] = own.min(0)
                    todo = todo[bounds[todo] < np.inf]
            todo = todo[np.argsort(bounds[todo], kind="stable")]
        while len(todo):
            look(todo[:step])
            todo = self._within(part, leaves, bounds, todo[step:])
            step = min(2 * step, LEAVES)

    def _within(self, part: slice, leaves: Leaves, bounds: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Those leaves of todo that can still matter to some query."""
        last = self.dist[part, -1]
        reach = np.minimum(last, self.limit[part])
        most = reach.max()
        # at the very bound only smaller identifiers count
        name = np.where(last <= self.limit[part], self.ids[part, -1], _NONE)[reach == most].max()
        return todo[(bounds[todo] < most) | ((bounds[todo] == most) & (leaves.first[todo] <= name))]

    def found(self, names: np.ndarray, kind: str, of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Columns name of the query, identifier, label, distance; of: for each name the place of its query, if names share queries."""
        q, r = np.nonzero(self.ids != _NONE)
        if of is None:
            names = names[q]
        else:
            n = np.bincount(q, minlength=len(self.queries))
            each, begin = n[of], (np.cumsum(n) - n)[of]
            at = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())
            names, q, r = np.repeat(names, each), q[at], r[at]
        return names, self.ids[q, r], self.labels[q, r], self.dist[q, r].astype(np.int64 if kind == "bigint" else np.float32)

    def _merge(self, first: int, dist: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        part = slice(first, first + len(dist))
        bound = np.minimum(self.dist[part, -1], self.limit[part])
        if dist.shape[1] > self.k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        q, at = np.divmod(np.flatnonzero(dist <= bound[:, None]), dist.shape[1])
        if not len(q):
            return
        some = np.unique(q)
        old = np.repeat(some, self.k)
        q = np.concatenate([old, q])
        d = np.concatenate([self.dist[part][some].ravel(), dist[q[len(old) :], at]])
        i = np.concatenate([self.ids[part][some].ravel(), ids[at]])
        f = np.concatenate([self.labels[part][some].ravel(), labels[at]])
        order = np.lexsort((i, d, q))
        q, d, i, f = q[order], d[order], i[order], f[order]
        begin = np.searchsorted(q, some)
        take = begin[:, None] + np.arange(self.k)  # each has its k old places at least
        self.dist[first + some], self.ids[first + some], self.labels[first + some] = d[take], i[take], f[take]


def alike(points: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
    """For each point the number of its class, by first appearance: equal points with equal limits, which have the same neighbours."""
    columns = [c.astype(np.int64) if c.dtype.kind == "i" else np.ascontiguousarray(c, np.float64).view(np.int64) for c in (*points.T, *([] if limits is None else [limits]))]
    key = np.zeros(len(points), np.int64)
    for c, odd in zip(columns, np.random.default_rng(1).integers(1 << 60, 1 << 62, len(columns)) | 1, strict=True):
        key += c * odd
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    if any((c != c[first][back]).any() for c in columns):  # two unlike points have one key
        _, first, back = np.unique(np.column_stack(columns), axis=0, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[back.ravel()]


def groups(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches with rows, as many at a time as MOST_HELD allows for the columns after the first ones."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows * (batch.num_columns - first) >= MOST_HELD:
            yield held
            held, rows = [], 0
    if held:
        yield held


def pieces(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The first columns and the others as a matrix, of as many rows at a time as MOST_HELD allows."""
    for held in groups(batches, first):
        columns = [pa.concat_arrays(x).to_numpy(zero_copy_only=False) for x in zip(*(b.columns for b in held), strict=True)]
        yield columns[:first], np.column_stack(columns[first:])


def in_batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns as batches of OUT_ROWS rows."""
    whole_ = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)
    for begin in range(0, whole_.num_rows, OUT_ROWS):
        yield whole_.slice(begin, OUT_ROWS)


def brought(rows: DataFrame, first: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first columns and the others as a matrix, on the driver, near rows together; for about MAX_QUERIES rows of numbers at most."""
    table = rows.toArrow()
    columns = [c.to_numpy() for c in table.columns]
    points = np.column_stack(columns[first:])
    order = arranged(points, GROUP)[0]
    return [c[order] for c in columns[:first]], points[order]


def few(vectors: DataFrame) -> DataFrame:
    """vectors in at most as many tasks as run at a time: a task keeps what it found, which bounds the rest of its search, and gives it once."""
    return vectors.coalesce(max(1, vectors.sparkSession.sparkContext.defaultParallelism))


def _nearest(queries: DataFrame, vectors: DataFrame, dim: int, k: int, measure, kind: str) -> DataFrame:
    names = [f"v{j}" for j in range(dim)]
    sc = queries.sparkSession.sparkContext

    def of(block: DataFrame) -> DataFrame:
        (qids,), points = brought(block.select("orig_id", *names), 1)
        sent = sc.broadcast((qids, points))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, points = sent.value
            _, first, of = np.unique(alike(points), return_index=True, return_inverse=True)
            best = Nearest(points[first], k, measure)
            for (ids, labels), values in pieces(batches, 2):
                best.add(Leaves(ids, labels.astype(bool), values, measure))
            yield from in_batches(best.found(qids, kind, of), ["qid", "orig_id", "is_fraud", "dist"])

        return few(vectors.select("orig_id", "is_fraud", *names)).mapInArrow(near, f"qid bigint, orig_id bigint, is_fraud boolean, dist {kind}")

    return top_k(reduce(DataFrame.unionByName, [of(b) for b in blocks(queries)]), ["qid"], k)


def summary(queries: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """qid, n, low, high, total: number, least, greatest and sum of each query's distances from all vectors, in whole numbers.

    The sum over v of |q - v|^2 is n |q|^2 - 2 q . (sum of v) + (sum of |v|^2); the extremes are the nearest and the farthest vector.
    """
    names = [f"v{j}" for j in range(dim)]
    sc = queries.sparkSession.sparkContext

    def of(block: DataFrame) -> DataFrame:
        (qids,), points = brought(block.select("orig_id", *names), 1)
        sent = sc.broadcast((qids, points))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, points = sent.value
            low, high = Nearest(points, 1), Nearest(points, 1, far=True)
            n, sums, squares = 0, np.zeros(dim, np.int64), 0
            for (ids, labels), values in pieces(batches, 2):
                leaves = Leaves(ids, labels.astype(bool), values)
                low.add(leaves)
                high.add(leaves)
                values = values.astype(np.int64)
                n, sums, squares = n + len(values), sums + values.sum(0), squares + int((values * values).sum())
            if n and len(qids):
                q = points.astype(np.int64)
                total = n * (q * q).sum(1) - 2 * (q @ sums) + squares
                yield from in_batches([qids, np.full(len(qids), n), low.dist[:, 0].astype(np.int64), (-high.dist[:, 0]).astype(np.int64), total], ["qid", "n", "low", "high", "total"])

        return few(vectors.select("orig_id", "is_fraud", *names)).mapInArrow(work, "qid bigint, n bigint, low bigint, high bigint, total bigint")

    parts = reduce(DataFrame.unionByName, [of(b) for b in blocks(queries)])
    return parts.groupBy("qid").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


def many_pairs(queries: DataFrame, vectors: DataFrame) -> bool:
    """Whether there are more than DENSE pairs."""
    return queries.count() * vectors.count() > DENSE


def exact_knn(queries: DataFrame, vectors: DataFrame, dim: int, k: int = K) -> DataFrame:
    """qid, orig_id, is_fraud, dist, rank: the k nearest vectors of each query, in whole numbers.

    Of more than DENSE pairs, vectors are first dealt into cells, so that a query's own cell bounds what the others have to look at.
    """
    if many_pairs(queries, vectors):
        from .ivf import by_cells

        return by_cells(queries, vectors, dim, k)
    return _nearest(queries, vectors, dim, k, whole, "bigint")


def exact_knn_f32(queries: DataFrame, vectors: DataFrame, dim: int, k: int = K) -> DataFrame:
    """The same of vectors of floats, with distances in single precision."""
    return _nearest(queries, vectors, dim, k, single, "float")
