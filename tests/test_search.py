"""Search, k-means and recall against plain Python."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote.functions.constants import K
from nearvote.operators import ivf, kmeans, recall
from nearvote.operators.knn import exact_knn, exact_knn_f32
from nearvote.operators.scoring import decide, response_body
from nearvote.operators.topk import gathered, top_k, votes

DIM = 3
MAX = 2**63 - 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "orig_id bigint, is_fraud boolean, " + ", ".join(f"v{j} smallint" for j in range(DIM)))


def random_rows(rng, n, start=0, spread=400):
    centres = [[rng.randint(-9000, 9000) for _ in range(DIM)] for _ in range(12)]
    return [(start + i, rng.random() < 0.5, *(max(-10000, min(10000, c + rng.randint(-spread, spread))) for c in rng.choice(centres))) for i in range(n)]


def dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_knn(q, rows):
    return sorted((dist(q[2:], r[2:]), r[0], int(r[1])) for r in rows)[:K]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows, queries = random_rows(rng, 600, spread=2500), random_rows(rng, 40, 10_000, spread=6000)
    rows += [(700 + i, bool(i % 2), *rows[0][2:]) for i in range(8)]  # ties
    vectors = frame(spark, rows)
    clusters, assigned = ivf.build_index(vectors, 30, DIM, iterations=4, stop_below=0)
    return rows, queries, frame(spark, queries).persist(), clusters.persist(), assigned.persist()


def test_tie_break_and_votes(spark):
    rows = [(1, 10, True, 100), (1, 5, False, 200), (1, 10, True, 50), (1, 1, True, 300), (1, 7, False, 400), (1, 7, True, 350)]
    top = top_k(spark.createDataFrame(rows, "qid int, dist bigint, is_fraud boolean, orig_id bigint"), ["qid"])
    assert [r["orig_id"] for r in top.orderBy("rank").collect()] == [300, 200, 350, 400, 50]
    assert gathered(top, ["qid"]).select(votes(F.col("top"))).first()[0] == 3


def test_exact_knn(spark, data):
    rows, queries, qdf, _, assigned = data
    got = {}
    for r in exact_knn(qdf, assigned, DIM).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["orig_id"], int(r["is_fraud"])))
    assert got == {q[0]: plain_knn(q, rows) for q in queries}


def test_knn_of_few_vectors_and_blocks(spark, monkeypatch):
    rows = [(i, i < 2, i, 0, 0) for i in range(3)]
    queries = [(100 + i, False, i, 0, 0) for i in range(6)]
    monkeypatch.setattr("nearvote.operators.knn.MAX_QUERIES", 2)
    got = decide(exact_knn(frame(spark, queries), frame(spark, rows), DIM)).collect()
    assert {r["qid"] for r in got} == {q[0] for q in queries}
    assert all((r["fraud_count"], r["fraud_score"], r["approved"]) == (2, 0.4, True) for r in got)


def emulate(q, clusters, members, fast, full):
    """The sequential search, cluster by cluster."""
    top, probe = [], min(clusters, key=lambda c: (dist(q[2:], c["c"]), c["id"]))

    def scan(c):
        nonlocal top
        top = sorted(top + [(dist(q[2:], r[2:]), r[0], int(r[1])) for r in members.get(c["id"], [])])[:K]

    worst = lambda: top[-1][0] if len(top) == K else MAX
    fraud = lambda: sum(t[2] for t in top)
    scan(probe)
    visited, limit, escalated = 1, fast, False
    for c in sorted(clusters, key=lambda c: c["id"]):
        if c["id"] == probe["id"] or c["id"] not in members:
            continue
        if fast and visited >= limit:
            if escalated or not full or fraud() not in (2, 3):
                break
            escalated, limit = True, full
            if visited >= limit:
                break
        bound = sum(max(lo - x, 0, x - hi) ** 2 for x, lo, hi in zip(q[2:], c["lo"], c["hi"], strict=True))
        if bound <= worst():
            scan(c)
            visited += 1
    return fraud(), visited


@pytest.mark.parametrize("fast,full", [(0, 0), (1, 0), (2, 0), (2, 6), (3, 5), (8, 24)])
def test_budgeted_search(data, fast, full):
    rows, queries, qdf, clusters, assigned = data
    plain = [{"id": r["cluster_id"], "c": [r[f"c{j}"] for j in range(DIM)], "lo": [r[f"lo{j}"] for j in range(DIM)], "hi": [r[f"hi{j}"] for j in range(DIM)]} for r in clusters.collect()]
    members = {}
    for r in assigned.collect():
        members.setdefault(r["cluster_id"], []).append((r["orig_id"], r["is_fraud"], *(r[f"v{j}"] for j in range(DIM))))
    got = {r["qid"]: (r["fraud_count"], r["visited"]) for r in ivf.search(qdf, clusters, assigned, DIM, fast, full).collect()}
    assert got == {q[0]: emulate(q, plain, members, fast, full) for q in queries}
    if fast == 0:
        assert {q: n for q, (n, _) in got.items()} == {q[0]: sum(t[2] for t in plain_knn(q, rows)) for q in queries}


def test_scans_by_join_and_by_matrix_agree(spark, data, monkeypatch):
    _, _, qdf, clusters, assigned = data
    found = lambda: sorted(map(tuple, ivf.search(qdf, clusters, assigned, DIM, 3, 6).collect()))
    sent = found()
    monkeypatch.setattr(ivf, "MOST_SENT", 10)
    assert found() == sent


def test_two_clusters(spark):
    rows = [(i, True, 0, 0, 0) for i in range(4)] + [(4 + i, False, 10000, 10000, 10000) for i in range(4)]
    clusters, assigned = ivf.build_index(frame(spark, rows), 2, DIM)
    assert sorted(r["n"] for r in clusters.collect()) == [4, 4]
    got = ivf.search(frame(spark, [(99, False, 0, 0, 0)]), clusters, assigned, DIM).first()
    assert got["fraud_count"] == 4


def test_empty_cluster_is_kept(spark):
    vectors = frame(spark, [(1, True, 5, 5, 5), (2, False, 6, 6, 6)])
    centres = [(5, 5, 5), (900, 900, 900)]
    clusters = ivf.clusters_of(kmeans.assign(vectors, centres), centres).orderBy("cluster_id").collect()
    assert [r["n"] for r in clusters] == [2, 0] and clusters[1]["lo0"] == 0 and clusters[1]["c0"] == 900
    assert kmeans.lloyd(vectors, centres, 2)[1] == (900, 900, 900)


def test_bad_numbers_of_clusters(spark):
    with pytest.raises(ValueError):
        kmeans.seeds(frame(spark, [(1, True, 0, 0, 0)]), 2, DIM)
    with pytest.raises(ValueError):
        kmeans.seeds(frame(spark, [(1, True, 0, 0, 0)]), 5000, DIM)


def test_recall_thresholds(spark):
    rng = random.Random(7)
    base = [(i % 4) * 5000 - 8000 for i in range(200)]
    rows = [(i, i % 4 < 2, *(b + rng.randint(-300, 300) for _ in range(DIM))) for i, b in enumerate(base)]
    vectors = frame(spark, rows)
    # one seed in each group, as a converged model has
    clusters, assigned = (lambda c: (ivf.clusters_of(kmeans.assign(vectors, c), c), kmeans.assign(vectors, c)))(kmeans.lloyd(vectors, [(b,) * DIM for b in sorted(set(base))]))
    queries = vectors.where("orig_id % 5 = 0")
    r = recall.report(recall.compared(exact_knn(queries, vectors, DIM), ivf.search(queries, clusters, assigned, DIM, 0, 0)), "x").first()
    assert r["recall"] >= 0.99 and r["match_rate"] >= 0.99 and r["flip_rate"] == 0 and r["mean_visited"] <= 1.5 and r["max_visited"] <= 2


def test_percentiles_are_taken_by_index(spark):
    places = {"p50": (1, 2), "p99": (99, 100), "p999": (999, 1000)}
    row = recall.percentiles(spark.range(1, 2001), "id", places).first()
    assert tuple(row) == (1001, 1981, 1999)
    rng = random.Random(4)
    for n in (1, 2, 7, 100):
        values = sorted(rng.randint(0, 9) for _ in range(n))
        row = recall.percentiles(spark.createDataFrame([(v,) for v in values], "id int"), "id", places).first()
        assert tuple(row) == tuple(values[n * a // b] for a, b in places.values())
    assert tuple(recall.percentiles(spark.range(0), "id", places).first()) == (None, None, None)


def test_responses(spark):
    rows = spark.range(6).select(response_body(F.col("id").cast("int"))).collect()
    want = [f'{{"approved":{"true" if i < 3 else "false"},"fraud_score":{i / 5}}}' for i in range(6)]
    assert [r[0] for r in rows] == want


def test_plans_pair_no_rows(data):
    """Neighbours come from matrix products over batches, not from rows for each pair of a query and a vector."""
    _, _, qdf, clusters, assigned = data
    for df in (exact_knn(qdf, assigned, DIM), ivf.search(qdf, clusters, assigned, DIM)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_single_precision_neighbours(spark, data):
    rows, queries, qdf, _, assigned = data
    single = lambda df: df.select("orig_id", "is_fraud", *((F.col(f"v{j}").cast("float") * F.lit(0.0001).cast("float")).alias(f"v{j}") for j in range(DIM)))
    got = {}
    for r in exact_knn_f32(single(qdf), single(assigned), DIM).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["orig_id"]))
    for q in queries:
        want = []
        for r in rows:
            total = np.float32(0)
            for x, y in zip(q[2:], r[2:], strict=True):
                gap = np.float32(x) * np.float32(0.0001) - np.float32(y) * np.float32(0.0001)
                total = np.float32(total + gap * gap)
            want.append((float(total), r[0]))
        assert got[q[0]] == sorted(want)[:K]


@pytest.mark.parametrize("n_probe", [2, 5])
def test_several_probes(spark, data, n_probe):
    rows, queries, qdf, clusters, assigned = data
    got = {r["qid"]: r for r in ivf.search(qdf, clusters, assigned, DIM, 0, 0, n_probe=n_probe).collect()}
    assert {q: r["fraud_count"] for q, r in got.items()} == {q[0]: sum(t[2] for t in plain_knn(q, rows)) for q in queries}
    assert all(r["visited"] >= n_probe for r in got.values())
    only = ivf.search(qdf, clusters, assigned, DIM, n_probe, 0, n_probe=n_probe).collect()
    assert all(r["visited"] == n_probe for r in only)


def test_plus_plus_draws_by_distance(spark):
    rows = [(i, False, *(100 * (i % 3), 0, 0)) for i in range(60)]
    centres = kmeans.plus_plus(frame(spark, rows), 3, DIM, kmeans.drawn(1))
    assert sorted(centres) == [(0, 0, 0), (100, 0, 0), (200, 0, 0)]  # points that coincide with a centre have no weight
    same = kmeans.plus_plus(frame(spark, [(i, False, 5, 5, 5) for i in range(4)]), 3, DIM, kmeans.drawn(1))
    assert same == [(5, 5, 5)] * 3  # no weight is left: drawn evenly
    with pytest.raises(ValueError):
        kmeans.plus_plus(frame(spark, []), 1, DIM, kmeans.drawn(1))


def test_scans_keep_no_row_for_each_pair(spark, data, monkeypatch):
    """However many queries there are, a scan returns at most k rows of a query, cluster and piece; a join made one of each pair."""
    _, _, qdf, clusters, assigned = data
    monkeypatch.setattr(ivf, "MOST_SENT", 10)
    found = ivf.scan(ivf.probes(qdf, clusters, DIM), assigned.coalesce(1), DIM)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert max(r["count"] for r in found.groupBy("qid", "cluster_id").count().collect()) <= K
    near = ivf.candidates(qdf, clusters, assigned, DIM)
    assert near.where("is_probe").count() == qdf.count() and near.where("NOT is_probe AND lb > bound").count() == 0


def test_exact_neighbours_by_cells(spark, data, monkeypatch):
    rows, queries, qdf, _, assigned = data
    monkeypatch.setattr("nearvote.operators.knn.DENSE", 0)
    got = {}
    for r in exact_knn(qdf, assigned.drop("cluster_id"), DIM).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["orig_id"], int(r["is_fraud"])))
    assert got == {q[0]: plain_knn(q, rows) for q in queries}


@pytest.mark.parametrize("far", [False, True])
def test_leaves_lose_no_neighbour(far):
    """Ties, many copies and several pieces, against sorting all pairs; a leaf out of reach isn't looked at."""
    from nearvote.operators.knn import Leaves, Nearest, arranged, whole

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-10, 10, (3000, 4)), np.full((2000, 4), 3), rng.integers(-10_000, 10_000, (3000, 4))]).astype(np.int16)
    ids = rng.permutation(len(points))
    queries = np.concatenate([points[::40], rng.integers(-10_000, 10_000, (60, 4)).astype(np.int16)])
    queries = queries[arranged(queries, 64)[0]]
    near = Nearest(queries, 1 if far else K, far=far)
    seen = 0
    for part in np.array_split(rng.permutation(len(points)), 3):
        leaves = Leaves(ids[part], np.zeros(len(part), bool), points[part])
        near.add(leaves)
        seen += len(leaves.starts)
    dist = whole(queries.astype(float), points.astype(float)) * (-1 if far else 1)
    assert seen > 60
    for i in range(len(queries)):
        order = np.lexsort((ids, dist[i]))[: near.k]
        assert near.ids[i].tolist() == ids[order].tolist() and near.dist[i].tolist() == dist[i][order].tolist()


def test_few_boxes_are_compared_with_each_query(monkeypatch):
    """Queries take bounds from their likeliest leaves; before, each was compared with the box of nearly every leaf."""
    from nearvote.operators import knn

    rng = np.random.default_rng(6)
    points = rng.integers(-10_000, 10_000, (30_000, 3)).astype(np.int16)
    queries = points[::10][knn.arranged(points[::10], knn.GROUP)[0]]
    leaves = knn.Leaves(np.arange(len(points)), np.zeros(len(points), bool), points)
    compared = []
    for name in ("gaps", "between"):
        f = getattr(knn, name, None)
        monkeypatch.setattr(knn, name, lambda *boxes, f=f: compared.append((out := f(*boxes)).size) or out, raising=False)
    near = knn.Nearest(queries, K)
    near.add(leaves)
    dist = knn.whole(queries.astype(float), points.astype(float))
    assert (np.sort(dist, axis=1)[:, :K] == near.dist).all()
    assert sum(compared) < len(queries) * len(leaves.starts) / 4


@pytest.mark.parametrize("clash", [False, True])
def test_equal_queries_are_answered_once(clash, monkeypatch):
    """Equal queries share one search and each has its rows; before, each was searched for. Unlike points with one key stay apart."""
    from nearvote.operators import knn

    rng = np.random.default_rng(7)
    points = rng.integers(-50, 50, (500, 3)).astype(np.int16)
    if clash:
        monkeypatch.setattr(knn.np.random, "default_rng", lambda _: type("Zero", (), {"integers": lambda *_: np.zeros(3, np.int64)}))
    queries, names = points[rng.integers(0, 20, 300)], rng.permutation(300)
    same = knn.alike(queries)
    assert same.max() + 1 == len(np.unique(queries, axis=0)) and list(dict.fromkeys(same.tolist())) == list(range(same.max() + 1))
    _, first, of = np.unique(same, return_index=True, return_inverse=True)
    apart = knn.alike(queries[:, :2].astype(np.float32), np.arange(300.0)) if not clash else np.arange(300)
    assert apart.tolist() == list(range(300))  # limits differ
    leaves = knn.Leaves(np.arange(500), np.zeros(500, bool), points)
    shared, alone = knn.Nearest(queries[first], K), knn.Nearest(queries, K)
    shared.add(leaves)
    alone.add(leaves)
    for a, b in zip(shared.found(names, "bigint", of), alone.found(names, "bigint"), strict=True):
        assert a.tolist() == b.tolist()


def test_tables_leave_no_shuffle_files(spark):
    """What was shuffled to write a table is deleted; before, it stayed until the driver's garbage was collected."""
    import time

    from nearvote.operators.lineage import FREED, materialise

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, was = files(), spark.conf.get(FREED, None)
    table = materialise(spark.range(1000).repartition("id"), "some")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(FREED, None) == was
    assert table.count() == 1000


def test_summary_of_distances(spark, data):
    from nearvote.operators.knn import summary

    rows, queries, qdf, _, assigned = data
    plan = summary(qdf, assigned, DIM)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r["qid"]: (r["n"], r["low"], r["high"], r["total"]) for r in plan.collect()}
    for q in queries:
        every = [dist(q[2:], r[2:]) for r in rows]
        assert got[q[0]] == (len(every), min(every), max(every), sum(every))


def test_an_index_is_shuffled_in_bundles(spark, monkeypatch):
    """Rows of a cluster are shuffled together, compressed, and come out whole; before, each was a row of the shuffle."""
    monkeypatch.setattr(kmeans, "BUNDLE", 7)
    rows = random_rows(random.Random(3), 500)
    rows = [(r[0], None if r[0] % 5 == 0 else r[1], *r[2:]) for r in rows] + [(900 + i, True, 1, 2, 3) for i in range(100)]
    vectors = frame(spark, rows).repartition(3)
    centres = kmeans.seeds(vectors, 9, DIM)
    dealt = kmeans.dealt(vectors, centres)
    want = kmeans.assign(vectors, centres)
    assert dealt.schema == want.schema
    parts = dealt.rdd.glom().collect()
    assert sorted(map(repr, sum(parts, []))) == sorted(map(repr, want.collect()))
    clusters = [{r["cluster_id"] for r in p} for p in parts if p]
    assert sum(map(len, clusters)) == len(set().union(*clusters)) > 1  # each in one partition
    assert all([(r["cluster_id"], r["orig_id"]) for r in p] == sorted((r["cluster_id"], r["orig_id"]) for r in p) for p in parts)
    shuffled = [x for x in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "rangepartitioning" in x]
    assert shuffled and all("bundle" in x or "REPARTITION_BY_COL" in x for x in shuffled)
    wide = next(x for x in dealt._jdf.queryExecution().analyzed().toString().split("RepartitionByExpression")[1].splitlines()[1:] if "MapInArrow" in x)
    assert "bundle" in wide and "v0" not in wide.split("[")[-1]


def test_exact_neighbours_from_lists(data):
    rows, queries, qdf, clusters, assigned = data
    lists = ivf.visitable(qdf, clusters, assigned, DIM)
    got = {r["qid"]: [tuple(x) for x in r["top"]] for r in ivf.exact(lists).collect()}
    assert got == {q[0]: plain_knn(q, rows) for q in queries}


def _shuffled(plan):
    """Rows that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("n_probe", [1, 3])
def test_a_search_shuffles_only_what_it_found(data, monkeypatch, n_probe):
    """Before, a row for each query and cluster within its bound was shuffled, and lists of them once more; what probes were sent stayed on disk."""
    rows, queries, qdf, clusters, assigned = data
    sent, kind = [], type(qdf.sparkSession.sparkContext)
    broadcast = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append((len(value), out := broadcast(self, value))) or out)
    spark, small = qdf.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(small)
    spark.conf.set(small, "-1")  # as if tables were large
    try:
        lists = ivf.visitable(qdf, clusters, assigned, DIM, n_probe=n_probe)
        got = {r["qid"]: r for r in lists.collect()}
    finally:
        spark.conf.set(small, was)
    assert [b for n, b in sent if n == 4] and not any(os.path.exists(b._path) for n, b in sent if n == 4)
    moved = _shuffled(lists._jdf.queryExecution().executedPlan())
    held = ivf._found(qdf, clusters, assigned, DIM, K, n_probe)
    found = ivf._beyond_probes(qdf, clusters, assigned, DIM, K, n_probe, held).count()
    assert 0 < moved <= found + 3 * len(queries) and set(got) == {q[0] for q in queries}
    near = {}
    for r in ivf.candidates(qdf, clusters, assigned, DIM, n_probe=n_probe).where("NOT is_probe").collect():
        near.setdefault(r["qid"], []).append((r["cluster_id"], r["lb"]))
    assert {q: [(x["cluster_id"], x["lb"]) for x in r["others"]] for q, r in got.items()} == {q: sorted(near.get(q, [])) for q in got}
    assert all(r["n_probe"] == n_probe for r in got.values())
