"""Inverted-file search: clusters with bounding boxes, a probe, and an adaptive budget of further clusters.

Search works on whole numbers, or, with `single`, on queries, vectors, centres and boxes of floats in single precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.functions.constants import FAST, FULL, K
from nearvote.functions.distance import box_bound, l2

from . import kmeans
from .knn import Leaves, Nearest, alike, blocks, brought, gaps, in_batches, matrix, pieces, single, whole
from .lineage import materialise
from .topk import gathered, top_k, votes

NO_BOUND = 9_223_372_036_854_775_807
#: Pairs of a query and a cluster that are sent to every task at once, some 20 MB; more are sent in parts.
MOST_SENT = 400_000
#: Cells of an exact search over many pairs.
CELLS = 64


def _kind(vectors: DataFrame) -> str:
    """float if the vectors are floats, which is for single precision; else bigint, for whole numbers."""
    return "float" if vectors.schema["v0"].dataType.typeName() == "float" else "bigint"


def _top_kind(kind: str) -> str:
    return f"array<struct<dist: {kind}, orig_id: bigint, label: int>>"


def clusters_of(assigned: DataFrame, centres: kmeans.Centres) -> DataFrame:
    """cluster_id, n, c0..., lo0..., hi0...: a row for each centre; empty clusters have zeros."""
    dim = len(centres[0])
    boxes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.min(f"v{j}").alias(f"lo{j}") for j in range(dim)), *(F.max(f"v{j}").alias(f"hi{j}") for j in range(dim)))
    all_ = assigned.sparkSession.range(1).select(F.inline(kmeans.centre_column(centres))).withColumnRenamed("id", "cluster_id")
    joined = all_.join(boxes, "cluster_id", "left")
    return joined.select(
        "cluster_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), *(f"c{j}" for j in range(dim)),
        *(F.coalesce(f"lo{j}", F.lit(0).cast("smallint")).alias(f"lo{j}") for j in range(dim)),
        *(F.coalesce(f"hi{j}", F.lit(0).cast("smallint")).alias(f"hi{j}") for j in range(dim)),
    )


def build_index(vectors: DataFrame, n_clusters: int, dim: int, iterations: int = 25, stop_below: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(clusters, vectors with cluster_id)."""
    centres = kmeans.lloyd(vectors, kmeans.seeds(vectors, n_clusters, dim), iterations, stop_below)
    assigned = kmeans.assign(vectors, centres)
    return clusters_of(assigned, centres), assigned


def _queries(queries: DataFrame, dim: int) -> DataFrame:
    return queries.select(F.col("orig_id").alias("qid"), *(F.col(f"v{j}").alias(f"q{j}") for j in range(dim)))


def visits(queries: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """qid, q0..., cluster_id, n, centre_dist, lb: every query with every cluster; clusters are at most MAX_CLUSTERS rows."""
    both = _queries(queries, dim).crossJoin(F.broadcast(clusters))
    return both.select(
        "qid", *(f"q{j}" for j in range(dim)), "cluster_id", "n",
        l2("q", "c", dim).alias("centre_dist"),
        box_bound("q", "lo", "hi", dim).alias("lb"),
    )


def _sent(clusters: DataFrame, dim: int) -> Broadcast:
    """Numbers, sizes, centres and boxes of the clusters, at most MAX_CLUSTERS of them."""
    names = [f"{p}{j}" for p in ("c", "lo", "hi") for j in range(dim)]
    rows = clusters.orderBy("cluster_id").select("cluster_id", "n", *names).limit(kmeans.MAX_CLUSTERS + 1).collect()
    if len(rows) > kmeans.MAX_CLUSTERS:
        raise ValueError(f"more than {kmeans.MAX_CLUSTERS} clusters")
    values = np.array([r[2:] for r in rows], np.float64).reshape(len(rows), 3, dim)
    ids = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64)
    return clusters.sparkSession.sparkContext.broadcast((*ids, values[:, 0], values[:, 1], values[:, 2]))


def _nearest_centres(points: np.ndarray, centres: np.ndarray, n: int, kind: str) -> np.ndarray:
    """For each point the places of its n nearest centres, the first ones of equals."""
    dist = (single if kind == "float" else whole)(points, centres)
    return dist.argmin(1)[:, None] if n == 1 else np.argsort(dist, axis=1, kind="stable")[:, :n]


def _fields(queries: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*queries.schema.fields, *more])


def probes(queries: DataFrame, clusters: DataFrame, dim: int, n_probe: int = 1) -> DataFrame:
    """qid, q0..., cluster_id: the clusters with the nearest centres, the smallest number of equals; empty ones too."""
    sent, rows, names, kind = _sent(clusters, dim), _queries(queries, dim), [f"q{j}" for j in range(dim)], _kind(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, centres, _, _ = sent.value
        for batch in batches:
            near = _nearest_centres(matrix(batch, names), centres, n_probe, kind)
            row = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(ids[near.ravel()])], [*batch.schema.names, "cluster_id"])

    return rows.mapInArrow(work, _fields(rows, T.StructField("cluster_id", T.IntegerType())))


def _scanned(vectors: DataFrame, dim: int, k: int, sent: Broadcast, asked) -> DataFrame:
    """qid, cluster_id, orig_id, is_fraud, dist: for queries and the clusters they ask for, the k nearest of every piece of a cluster, within limits.

    sent: qids, points, limits and what else `asked`(those, cluster) needs to give the places of the queries that ask.
    """
    kind, fields = _kind(vectors), [f"v{j}" for j in range(dim)]
    measure, names = single if kind == "float" else whole, ["qid", "cluster_id", "orig_id", "is_fraud", "dist"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, points, limits = sent.value[:3]
        same = alike(points, limits)
        for (clusters, ids, labels), values in pieces(batches, 3):
            for c in np.unique(clusters).tolist():
                at = asked(sent.value, c)
                if len(at):
                    own = clusters == c
                    _, first, of = np.unique(same[at], return_index=True, return_inverse=True)  # equal queries are answered once
                    best = Nearest(points[at[first]], k, measure, limits[at[first]])
                    best.add(Leaves(ids[own], labels[own].astype(bool), values[own], measure))
                    qid, orig_id, label, dist = best.found(qids[at], kind, of)
                    yield from in_batches([qid, np.full(len(qid), c, np.int32), orig_id, label, dist], names)

    return vectors.select("cluster_id", "orig_id", "is_fraud", *fields).mapInArrow(work, f"qid bigint, cluster_id int, orig_id bigint, is_fraud boolean, dist {kind}")


def _asked_by_name(sent: tuple, c: int) -> np.ndarray:
    return np.flatnonzero(sent[3] == c)


def _asked_by_box(sent: tuple, c: int) -> np.ndarray:
    """Queries whose limit reaches the box of cluster c, but for those that it was a probe of."""
    _, points, limits, probed, ids, _, low, high = sent
    i, real = int(np.searchsorted(ids, c)), low.dtype
    return np.flatnonzero((gaps(points.astype(real), low[i], high[i]) <= limits) & ~(probed == c).any(1))


def scan(chosen: DataFrame, vectors: DataFrame, dim: int, k: int = K, sent: list[Broadcast] | None = None) -> DataFrame:
    """qid, cluster_id, orig_id, is_fraud, dist for chosen (qid, q0..., cluster_id and perhaps bound): vectors of the cluster, within the bound.

    All that can be among the k nearest of a query and cluster are there. The rows of chosen go to where the vectors are, about MOST_SENT at a
    time, and a task returns its k nearest. sent: gets what was sent, which may be destroyed once the result is written.
    """
    names, bounded = [f"q{j}" for j in range(dim)], "bound" in chosen.columns
    extra = ["qid", "cluster_id", *(["bound"] if bounded else [])]
    n = -(-chosen.count() // MOST_SENT)
    part = F.pmod(F.xxhash64("qid", "cluster_id"), F.lit(max(n, 1)))

    def of(rows: DataFrame) -> DataFrame:
        (qids, of_, *limit), points = brought(rows.select(*extra, *names), len(extra))
        limits = limit[0].astype(np.float64) if bounded else np.full(len(qids), np.inf)
        all_ = vectors.sparkSession.sparkContext.broadcast((qids, points, limits, of_))
        if sent is not None:
            sent.append(all_)
        return _scanned(vectors, dim, k, all_, _asked_by_name)

    return reduce(DataFrame.unionByName, [of(chosen if n <= 1 else chosen.where(part == b)) for b in range(max(n, 1))])


def _found(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, k: int, n_probe: int, sent: list[Broadcast] | None = None) -> DataFrame:
    """qid, top: the k nearest in the probes; queries whose probes are empty aren't there."""
    return gathered(top_k(scan(probes(queries, clusters, dim, n_probe), vectors, dim, k, sent), ["qid"], k), ["qid"])


def _bound(k: int, kind: str) -> Column:
    return F.when(F.size("top") >= k, F.element_at("top", k)["dist"]).otherwise(F.lit(NO_BOUND).cast(kind))


def candidates(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, k: int = K, n_probe: int = 1, found: DataFrame | None = None) -> DataFrame:
    """qid, q0..., cluster_id, n, lb, bound, is_probe: the probes, and the clusters whose box is within the k-th distance of what they hold.

    Only clusters that can still matter become rows; boxes are looked at once the bound is known. found: what the probes hold, if that is known.
    """
    found = _found(queries, clusters, vectors, dim, k, n_probe) if found is None else found
    kind = _kind(vectors)
    real = np.float32 if kind == "float" else np.float64
    rows = _queries(queries, dim).join(found.select("qid", _bound(k, kind).alias("bound")), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(NO_BOUND).cast(kind)))
    sent, names, width = _sent(clusters, dim), [f"q{j}" for j in range(dim)], dim + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, centres, low, high = sent.value
        low, high = low.astype(real), high.astype(real)
        for every in batches:
            for begin in range(0, every.num_rows, 256):
                batch = every.slice(begin, 256)
                points = matrix(batch, names).astype(real)
                probe = np.zeros((len(points), len(ids)), bool)
                probe[np.arange(len(points))[:, None], _nearest_centres(points, centres, n_probe, kind)] = True
                lb = gaps(points[:, None], low, high)
                lb = lb if kind == "float" else lb.astype(np.int64)
                row, c = np.nonzero(probe | ((sizes > 0) & (lb <= batch.column(width).to_numpy()[:, None])))
                kept = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns[:width], pa.array(ids[c]), pa.array(sizes[c]), pa.array(lb[row, c]), kept.column(width), pa.array(probe[row, c])], [*batch.schema.names[:width], "cluster_id", "n", "lb", "bound", "is_probe"])

    bounds = [T.StructField(c, T.FloatType() if kind == "float" else T.LongType()) for c in ("lb", "bound")]
    out = _fields(rows.drop("bound"), T.StructField("cluster_id", T.IntegerType()), T.StructField("n", T.LongType()), *bounds, T.StructField("is_probe", T.BooleanType()))
    return rows.select("qid", *names, "bound").mapInArrow(work, out)


def _bounded(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, k: int, n_probe: int, found: DataFrame) -> list[tuple[DataFrame, Broadcast]]:
    """Blocks of queries, each with its qids, points, bounds and probes, and the numbers, sizes and boxes of all clusters, sent to all tasks."""
    kind, sc = _kind(vectors), vectors.sparkSession.sparkContext
    real = np.float32 if kind == "float" else np.float64
    ids, sizes, centres, low, high = _sent(clusters, dim).value
    bounds = found.select("qid", _bound(k, kind).cast("double").alias("bound")).orderBy("qid").toArrow()
    named, most = bounds["qid"].to_numpy(), np.append(bounds["bound"].to_numpy(), np.float64(real(NO_BOUND)))

    def of(block: DataFrame) -> Broadcast:
        (qids,), points = brought(_queries(block, dim), 1)
        at = np.searchsorted(named, qids)
        known = np.append(named, -1)[at] == qids
        limits = most[np.where(known & (at < len(named)), at, len(named))]
        near = [_nearest_centres(points[i : i + 4096].astype(np.float64), centres, n_probe, kind) for i in range(0, len(points), 4096)]
        probed = ids[np.concatenate(near)] if near else np.zeros((0, 1), np.int32)
        return sc.broadcast((qids, points, limits, probed, ids, sizes, low.astype(real), high.astype(real)))

    return [(b, of(b)) for b in blocks(queries)]


def _beyond_probes(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, k: int, n_probe: int, found: DataFrame) -> DataFrame:
    """qid, cluster_id, orig_id, is_fraud, dist: within the bound of each query, the k nearest of each cluster that isn't a probe.

    Queries go to where the vectors are, which know the boxes of their clusters, so no row is made for a query and a cluster.
    """
    return reduce(DataFrame.unionByName, [_scanned(vectors, dim, k, sent, _asked_by_box) for _, sent in _bounded(queries, clusters, vectors, dim, k, n_probe, found)])


def _with_near(rows: DataFrame, sent: Broadcast, kind: str) -> DataFrame:
    """rows (qid and more) with n_probe and near: numbers and box bounds of the clusters within the query's bound, but for its probes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, points, limits, probed, ids, sizes, low, high = sent.value
        order = np.argsort(qids, kind="stable")
        for every in batches:
            for begin in range(0, every.num_rows, 256):
                batch = every.slice(begin, 256)
                at = order[np.searchsorted(qids, batch.column(0).to_numpy(), sorter=order)]
                lb = gaps(points[at].astype(low.dtype)[:, None], low, high)
                near = (sizes > 0) & (lb <= limits[at][:, None]) & ~(probed[at][:, :, None] == ids).any(1)
                row, c = np.nonzero(near)
                bounds = lb[row, c] if kind == "float" else lb[row, c].astype(np.int64)
                listed = pa.StructArray.from_arrays([pa.array(ids[c]), pa.array(bounds)], ["cluster_id", "lb"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(near.sum(1))), pa.int32()), listed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), probed.shape[1], np.int32)), listed], [*batch.schema.names, "n_probe", "near"])

    item = T.StructType([T.StructField("cluster_id", T.IntegerType()), T.StructField("lb", T.FloatType() if kind == "float" else T.LongType())])
    return rows.mapInArrow(work, _fields(rows, T.StructField("n_probe", T.IntegerType()), T.StructField("near", T.ArrayType(item))))


def by_cells(queries: DataFrame, vectors: DataFrame, dim: int, k: int = K) -> DataFrame:
    """qid, orig_id, is_fraud, dist, rank: the k nearest of all vectors, which are dealt into CELLS cells for this search alone.

    What a query finds in the cell with the nearest centre bounds its search of the others; none whose box is within the bound is left out.
    """
    centres = kmeans.seeds(vectors, min(CELLS, vectors.limit(CELLS).count()), dim)
    assigned = materialise(kmeans.assign(vectors, centres).repartitionByRange("cluster_id", "orig_id").sortWithinPartitions("cluster_id"), "cells")
    clusters = materialise(clusters_of(assigned, centres), "cell-boxes")
    columns = ["qid", "orig_id", "is_fraud", "dist"]
    home = materialise(top_k(scan(probes(queries, clusters, dim), assigned, dim, k), ["qid"], k).select(columns), "home")
    others = _beyond_probes(queries, clusters, assigned, dim, k, 1, gathered(home, ["qid"]))
    return top_k(home.unionByName(others.select(columns)), ["qid"], k)


def _merge(fast: int, full: int, k: int, kind: str):
    """One step of the search over clusters in order of their number; see `search`."""

    def step(s: Column, x: Column) -> Column:
        worst = F.when(F.size(s["top"]) >= k, F.element_at(s["top"], -1)["dist"]).otherwise(F.lit(NO_BOUND).cast(kind))
        unsure = votes(s["top"]).isin(2, 3)
        limit = F.when(s["esc"], F.lit(full)).otherwise(F.lit(fast))
        over = (s["vis"] >= limit) & (s["esc"] | ~unsure | F.lit(full == 0)) & F.lit(fast > 0)
        stop = s["stop"] | over
        take = ~stop & (x["lb"] <= worst)
        return F.struct(
            F.when(take, F.slice(F.array_sort(F.concat(s["top"], x["top"])), 1, k)).otherwise(s["top"]).alias("top"),
            F.when(take, s["vis"] + 1).otherwise(s["vis"]).alias("vis"),
            F.when(~stop & F.lit(fast > 0), s["esc"] | (s["vis"] >= fast)).otherwise(s["esc"]).alias("esc"),
            stop.alias("stop"),
        )

    return step


def visitable(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, k: int = K, n_probe: int = 1) -> DataFrame:
    """qid, probe_top, n_probe, others (cluster_id, lb, top): what any search of these queries may visit; see `fold`."""
    probing: list[Broadcast] = []
    held = materialise(_found(queries, clusters, vectors, dim, k, n_probe, probing), "probes")
    for sent in probing:
        sent.destroy()
    kind = _kind(vectors)
    empty = F.array().cast(_top_kind(kind))

    def of(block: DataFrame, sent: Broadcast) -> DataFrame:
        # only what was found is shuffled, once, by query; boxes are looked at where a query's own row is, so none is shuffled
        found = _scanned(vectors, dim, k, sent, _asked_by_box).repartition("qid")
        tops = gathered(top_k(found, ["qid", "cluster_id"], k), ["qid", "cluster_id"])
        tops = tops.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", F.col("top").cast(_top_kind(kind)).alias("top")))).alias("tops"))
        return _with_near(block.select(F.col("orig_id").alias("qid")).distinct().join(tops, "qid", "left").join(held, "qid", "left"), sent, kind)

    rows = reduce(DataFrame.unionByName, [of(*b) for b in _bounded(queries, clusters, vectors, dim, k, n_probe, held)])
    others = F.transform("near", lambda x: F.struct(x["cluster_id"].alias("cluster_id"), x["lb"].alias("lb"), F.coalesce(F.col("tops")[x["cluster_id"]], empty).alias("top")))
    return rows.select("qid", F.coalesce(F.col("top").cast(_top_kind(kind)), empty).alias("probe_top"), "n_probe", others.alias("others"))


def exact(lists: DataFrame, k: int = K) -> DataFrame:
    """qid, top: the k nearest of all vectors, from `visitable` lists; those leave out no cluster whose box is within the bound."""
    every = F.concat("probe_top", F.flatten(F.transform("others", lambda x: x["top"])))
    return lists.select("qid", F.slice(F.array_sort(every), 1, k).alias("top"))


def fold(lists: DataFrame, fast: int = FAST, full: int = FULL, k: int = K) -> DataFrame:
    """qid, top, fraud_count, visited of `visitable` lists, under one budget; several budgets can share the lists."""
    start = F.struct(F.col("probe_top").alias("top"), F.col("n_probe").alias("vis"), F.lit(False).alias("esc"), F.lit(False).alias("stop"))
    kind = lists.schema["probe_top"].dataType.elementType["dist"].dataType.simpleString()
    end = F.aggregate("others", start, _merge(fast, full, k, kind))
    done = lists.select("qid", end.alias("s"))
    return done.select("qid", F.col("s.top").alias("top"), votes(F.col("s.top")).alias("fraud_count"), F.col("s.vis").alias("visited"))


def search(queries: DataFrame, clusters: DataFrame, vectors: DataFrame, dim: int, fast: int = FAST, full: int = FULL, k: int = K, n_probe: int = 1) -> DataFrame:
    """qid, top, fraud_count, visited for each query.

    The n_probe clusters with the nearest centres are visited first. Others follow by number; one whose box may hold a nearer vector is visited,
    until `fast` clusters were. If the vote is then 2 or 3, visits go on up to `full`; full = 0 never goes on, and
    fast = 0 knows no budget, which makes the search exact. Each cluster's own k nearest are enough to merge, so the
    sequential search is a fold over a short list for each query.
    """
    return fold(visitable(queries, clusters, vectors, dim, k, n_probe), fast, full, k)
