"""k-means in integers: exact sums, so that results don't depend on the order of rows or tasks.

Distances to centres are matrix products of whole numbers in double precision, exact below 2 ** 53, over batches of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .knn import groups, matrix

#: Centres have at most so many clusters and come to the driver as rows of integers.
MAX_CLUSTERS = 4_096
#: Vectors from which centres are drawn, and the steps of a draw.
MOST_SAMPLED, DRAWS = 20_000, 10_000
#: Rows of a cluster that are shuffled as one.
BUNDLE = 4_096
Centres = list[tuple[int, ...]]


def seed_order(orig_id: Column) -> Column:
    """A fixed pseudo-random order of vectors; the first ones are the first centres."""
    return (orig_id * F.lit(7919)) % F.lit(10007)


def seeds(vectors: DataFrame, n: int, dim: int) -> Centres:
    if not 1 <= n <= MAX_CLUSTERS:
        raise ValueError(f"between 1 and {MAX_CLUSTERS} clusters, not {n}")
    rows = vectors.orderBy(seed_order(F.col("orig_id")), "orig_id").limit(n).select(*(f"v{j}" for j in range(dim))).collect()
    if len(rows) < n:
        raise ValueError(f"{len(rows)} vectors are too few for {n} clusters")
    return [tuple(r) for r in rows]


def centre_column(centres: Centres) -> Column:
    """The centres as a literal array of structs (id, c0, c1 ...)."""
    return F.expr(_centre_sql(centres))


def _centre_sql(centres: Centres) -> str:
    rows = [{"id": i, **{f"c{j}": x for j, x in enumerate(c)}} for i, c in enumerate(centres)]
    kind = "array<struct<id:int," + ",".join(f"c{j}:int" for j in range(len(centres[0]))) + ">>"
    return f"from_json('{json.dumps(rows)}', '{kind}')"


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, the smallest of equals."""
    own = (centres * centres).sum(1)
    out = [np.argmin(own - 2.0 * (rows[a : a + 4096] @ centres.T), axis=1) for a in range(0, len(rows), 4096)]
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def assign(vectors: DataFrame, centres: Centres) -> DataFrame:
    """vectors with cluster_id; no join and no shuffle."""
    points, names = np.array(centres, np.float64), [f"v{j}" for j in range(len(centres[0]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest(matrix(batch, names), points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "cluster_id"])

    return vectors.mapInArrow(work, T.StructType([*vectors.schema.fields, T.StructField("cluster_id", T.IntegerType())]))


def _bundles(batches: Iterator[pa.RecordBatch], points: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """cluster_id and bundle: up to BUNDLE rows of a cluster as a compressed Arrow stream, ordered by their first column."""
    for held in groups(batches, 0):
        rows = pa.Table.from_batches(held).combine_chunks()
        found = np.concatenate([nearest(matrix(b, names), points) for b in held])
        order = np.lexsort((rows.column(0).to_numpy(), found))
        starts = np.append(np.flatnonzero(np.diff(found[order], prepend=-1)), len(order))
        clusters, bundles = [], []
        for a, end in zip(starts, starts[1:], strict=False):
            for i in range(a, end, BUNDLE):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.take(pa.array(order[i : min(i + BUNDLE, end)])).combine_chunks())
                clusters.append(found[order[i]])
                bundles.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(bundles, pa.binary())], ["cluster_id", "bundle"])


def dealt(vectors: DataFrame, centres: Centres) -> DataFrame:
    """vectors with cluster_id, dealt by it into partitions and sorted in them by cluster_id and orig_id; bundles of rows are shuffled."""
    points, names = np.array(centres, np.float64), [f"v{j}" for j in range(len(centres[0]))]
    first = vectors.select("orig_id", *(c for c in vectors.columns if c != "orig_id"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, bundle in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with pa.ipc.open_stream(bundle.as_buffer()) as stream:
                    for rows in stream:
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, cluster, np.int32))], [*rows.schema.names, "cluster_id"])

    bundles = first.mapInArrow(lambda batches: _bundles(batches, points, names), "cluster_id int, bundle binary").repartitionByRange("cluster_id")
    rows = bundles.mapInArrow(unpack, T.StructType([*first.schema.fields, T.StructField("cluster_id", T.IntegerType())]))
    return rows.select(*vectors.columns, "cluster_id").sortWithinPartitions("cluster_id", "orig_id")


def means(assigned: DataFrame, dim: int) -> DataFrame:
    """cluster_id, n, c0...: means of each cluster, rounded towards zero."""
    sums = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.sum(F.col(f"v{j}").cast("bigint")).alias(f"s{j}") for j in range(dim)))
    return sums.select("cluster_id", "n", *(F.expr(f"cast(s{j} div n as int)").alias(f"c{j}") for j in range(dim)))


def updated(rows: list, centres: Centres) -> Centres:
    """New centres from rows of `means`; an empty cluster keeps its centre."""
    out = list(centres)
    for r in rows:
        out[r["cluster_id"]] = tuple(r[f"c{j}"] for j in range(len(centres[0])))
    return out


def passed(vectors: DataFrame, centres: Centres, before: Centres | None = None) -> DataFrame:
    """cluster_id, n, s0... (sums), moved (rows nearest to another centre of `before`): one pass, a row for each cluster and task to shuffle."""
    dim = len(centres[0])
    points, names = np.array(centres, np.float64), [f"v{j}" for j in range(dim)]
    earlier = None if before is None else np.array(before, np.float64)
    sums = [f"s{j}" for j in range(dim)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), dim + 2), np.int64)
        for batch in batches:
            rows = matrix(batch, names)
            at = nearest(rows, points)
            total[:, 0] += np.bincount(at, minlength=len(points))
            for j in range(dim):
                total[:, j + 1] += np.bincount(at, rows[:, j], len(points)).astype(np.int64)  # whole numbers, exact
            if earlier is not None:
                total[:, -1] += np.bincount(at[nearest(rows, earlier) != at], minlength=len(points))
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, k]) for k in range(dim + 2))], ["cluster_id", "n", *sums, "moved"])

    parts = vectors.select(*names).mapInArrow(work, "cluster_id int, n bigint, " + ", ".join(f"{c} bigint" for c in sums) + ", moved bigint")
    return parts.groupBy("cluster_id").agg(*(F.sum(c).alias(c) for c in ["n", *sums, "moved"]))


def cost(vectors: DataFrame, centres: Centres) -> DataFrame:
    """cost: the sum of squared distances to the nearest centre."""
    points, names = np.array(centres, np.float64), [f"v{j}" for j in range(len(centres[0]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch, names)
            yield pa.RecordBatch.from_arrays([pa.array([float(((rows - points[nearest(rows, points)]) ** 2).sum())])], ["cost"])

    return vectors.select(*names).mapInArrow(work, "cost double").agg(F.sum("cost").alias("cost"))


def changed(vectors: DataFrame, old: Centres, new: Centres) -> DataFrame:
    """n, changed: how many vectors are nearest to a centre of another number."""
    return passed(vectors, new, old).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.sum("moved").alias("changed"))


def lloyd(vectors: DataFrame, centres: Centres, iterations: int = 25, stop_below: float = 0.001) -> Centres:
    """Centres after at most `iterations` rounds, or once less than that share of vectors has changed cluster.

    A round is one pass over the vectors, which also counts the changes, and a shuffle of a row for each cluster and task.
    """
    dim, before = len(centres[0]), None
    for _ in range(iterations):
        rows = passed(vectors, centres, before if stop_below > 0 else None)
        rows = rows.select("cluster_id", "n", "moved", *(F.expr(f"cast(s{j} div n as int)").alias(f"c{j}") for j in range(dim))).collect()  # a row for each cluster
        done = before is not None and stop_below > 0 and sum(r["moved"] for r in rows) < stop_below * sum(r["n"] for r in rows)
        before, centres = centres, updated(rows, centres)
        if done:
            break
    return centres


def sampled(vectors: DataFrame, dim: int, most: int = MOST_SAMPLED) -> list[tuple[int, ...]]:
    """At most `most` vectors, the first ones in a fixed pseudo-random order, for seeding."""
    rows = vectors.orderBy(seed_order(F.col("orig_id")), "orig_id").limit(most).select(*(f"v{j}" for j in range(dim))).collect()
    return [tuple(r) for r in rows]


def plus_plus(vectors: DataFrame, n: int, dim: int, draws: Iterator[int], most: int = MOST_SAMPLED) -> Centres:
    """Centres by k-means++ seeding over at most `most` vectors.

    The first is drawn evenly, each further one with a chance in proportion to its squared distance from the nearest centre so far: the
    first vector at which the running sum of these weights reaches draw / DRAWS of their total. If the total is 0, the draw is
    even again. draws: numbers from 0 to DRAWS - 1, such as those of `drawn`. All sums are whole numbers.
    """
    if not 1 <= n <= MAX_CLUSTERS:
        raise ValueError(f"between 1 and {MAX_CLUSTERS} clusters, not {n}")
    rows = sampled(vectors, dim, most)
    if not rows:
        raise ValueError("there are no vectors to draw centres from")
    points = np.array(rows, np.int64)
    picked = next(draws) * len(rows) // DRAWS
    weight = ((points - points[picked]) ** 2).sum(1)
    chosen = [picked]
    while len(chosen) < n:
        running = np.cumsum(weight)
        total, draw = int(running[-1]), next(draws)
        # the smallest whole sum that is at least draw / DRAWS of the total
        picked = int(np.searchsorted(running, -(-draw * total // DRAWS))) if total else draw * len(rows) // DRAWS
        weight = np.minimum(weight, ((points - points[picked]) ** 2).sum(1))
        chosen.append(picked)
    return [rows[i] for i in chosen]


def drawn(seed: int) -> Iterator[int]:
    """A fixed sequence of pseudo-random numbers below DRAWS."""
    x = seed
    while True:
        x = (x * 48271 + 11) % 2147483647
        yield x % DRAWS


def mllib_centres(vectors: DataFrame, n: int, dim: int, seed: int = 42, iterations: int = 25) -> Centres:
    """Centres by k-means|| seeding, rounded to integers; random, so without an exact counterpart in SQL."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[f"v{j}" for j in range(dim)], outputCol="features").transform(vectors)
    model = KMeans(k=n, seed=seed, maxIter=iterations, initMode="k-means||").fit(rows)
    return [tuple(int(round(x)) for x in c) for c in model.clusterCenters()]
