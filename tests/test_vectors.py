"""The inverted file, the graph of neighbours, communities, outliers and labels against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import clusters, vectors
from graphloom.operators.vectors import VectorIndex, neighbour_graph

RNG = np.random.default_rng(2)
CENTRES = RNG.normal(size=(6, 12))
ROWS = [(i, [float(x) for x in CENTRES[i % 6] + 0.4 * RNG.normal(size=12)]) for i in range(400)]
ROWS += [(1000 + i, ROWS[0][1]) for i in range(60)]  # a group of copies
ODD = [(2000, None), (2001, []), (2002, [1.0, None, *[0.0] * 10]), (2003, [float("nan")] * 12), (2004, [0.0] * 12), (None, ROWS[1][1])]


def brute(rows, queries, k, cosine):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    if cosine:
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        v = m[list(ids).index(q)]
        score = m @ v if cosine else -np.sqrt(((m - v) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), round(float(score[i]), 6)) for i in order]
    return out


@pytest.fixture(scope="module")
def table_(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS + ODD], "vec_id long, embedding array<double>, cell string").repartition(4)


@pytest.mark.parametrize("cosine", [True, False])
def test_exact_search_equals_brute_force(spark, table_, tmp_path, monkeypatch, cosine):
    monkeypatch.setattr(vectors, "GROUP", 25)  # so that cells, and the copies, lie in several groups
    VectorIndex.build(table_, f"file://{tmp_path}/index", cosine=cosine)
    index = VectorIndex(spark, f"file://{tmp_path}/index")  # read back
    asked = table_.filter("vec_id % 20 = 0 and vec_id < 2000").select(F.col("vec_id").alias("query_id"), "embedding")
    found = {}
    for r in index.search(asked, 8, probes=1, exact=True).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    want = brute(ROWS + ([(2004, [0.0] * 12)] if not cosine else []), sorted(found), 8, cosine)
    assert len(found) == 23
    for q in found:  # scores of copies may differ in the last place
        assert [s for _, s in found[q]] == [s for _, s in want[q]], q
        assert {i for i, s in found[q] if s > want[q][-1][1]} == {i for i, s in want[q] if s > want[q][-1][1]}
    near = {(r.query_id, r.id) for r in index.search(asked, 8).collect()}
    true = sum((q, i) in near for q in want for i, _ in want[q]) / sum(map(len, want.values()))
    assert true >= 0.9


def test_probes_read_few_cells(spark, table_, tmp_path):
    index = VectorIndex.build(table_, f"file://{tmp_path}/index", cells=20)
    asked = table_.filter("vec_id = 20").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = index.search(asked, 3, probes=2)
    assert plan.count() == 3
    probed = index.probes(vectors.units(asked, "query_id", "embedding").select(F.col("id").alias("query_id"), "v"), 2)
    cells = [r.cell for r in probed.collect()]
    read = index.codes.filter(F.col("cell").isin(cells))
    assert len(cells) == 2 and read.select(F.input_file_name()).distinct().count() == 2
    assert "PartitionFilters: [cell" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() < index.codes.count() / 2


def test_graph_recall_and_empty(spark, table_):
    got = {(r.id, r.other) for r in neighbour_graph(table_.filter("vec_id < 400"), 8).collect()}
    want = brute(ROWS[:400], range(400), 8, True)
    assert len(got) == 3200 and all(a != b for a, b in got)
    assert sum((q, i) in got for q in want for i, _ in want[q]) >= 0.95 * 3200
    assert neighbour_graph(table_.limit(0), 8).count() == 0


def planted(groups, size, inner, outer, seed):
    rng = random.Random(seed)
    nodes = range(groups * size)
    return [(a, b, 1.0) for a, b in itertools.combinations(nodes, 2) if rng.random() < (inner if a // size == b // size else outer)]


def plain_modularity(pairs, part):
    degree, total = {}, 0.0
    for a, b, w in pairs:
        degree[a], degree[b], total = degree.get(a, 0) + w, degree.get(b, 0) + w, total + 2 * w
    inner = sum(2 * w for a, b, w in pairs if part[a] == part[b])
    return inner / total - sum(sum(d for n, d in degree.items() if part[n] == c) ** 2 for c in set(part.values())) / total**2


def test_communities_find_planted_groups(spark):
    pairs = planted(5, 14, 0.7, 0.02, 3) + [(200, 201, 1.0), (201, 202, 1.0)]
    edges = clusters.undirected(spark.createDataFrame(pairs, "id long, other long, score double"))
    found = clusters.communities(edges)
    part = {r.id: r.community for r in found.collect()}
    truth = {n: n // 14 if n < 100 else 99 for n in part}
    assert len(part) == len({n for a, b, _ in pairs for n in (a, b)})
    for c in set(part.values()):
        assert c == min(n for n in part if part[n] == c)
    assert abs(clusters.modularity(edges, found) - plain_modularity(pairs, part)) < 1e-9
    assert plain_modularity(pairs, part) >= 0.98 * plain_modularity(pairs, truth)
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for c in set(part.values()):
        nodes = {n for n in part if part[n] == c}
        seen, waiting = {c}, [c]
        while waiting:
            for n in near[waiting.pop()] & nodes - seen:
                seen.add(n)
                waiting.append(n)
        assert seen == nodes


def test_communities_of_nothing(spark):
    assert clusters.communities(clusters.undirected(spark.createDataFrame([], "id long, other long, score double"))).count() == 0


def test_long_chains_are_connected(spark):
    edges = clusters.undirected(spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 60)], "id long, other long, score double"))
    one = edges.select(F.col("a").alias("id")).distinct().withColumn("community", F.when(F.col("id") == 30, 1).otherwise(0))
    assert {(r.id, r.community) for r in clusters.connected(edges, one).collect()} == {(i, 0 if i < 30 else 30 if i == 30 else 31) for i in range(61)}


def test_outliers_of_a_far_point(spark):
    rng = random.Random(7)
    at = {i: (rng.random(), rng.random()) for i in range(60)} | {60: (9.0, 9.0)}
    near = []
    for i, (x, y) in at.items():
        near += [(i, j, d) for d, j in sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, (u, v) in at.items() if j != i)[:5]]
    rows = {r.id: (r.lof, r.is_outlier) for r in clusters.outliers(spark.createDataFrame(near, "id long, other long, distance double")).collect()}
    assert rows[60][1] and rows[60][0] == max(f for f, _ in rows.values())
    assert sum(o for _, o in rows.values()) == 2  # those above the interpolated 98th percentile of 61


def test_labels_prefer_what_is_distinct(spark):
    texts = [("a", "common alpha alpha"), ("a", None), ("b", "common beta"), ("b", "Beta, common!"), (None, "noise noise"), ("c", "")]
    got = [(r.cluster, r.term) for r in clusters.cluster_labels(spark.createDataFrame(texts, "c string, text string"), "c", k=1).collect()]
    assert sorted(got) == [("a", "alpha"), ("b", "beta")]


@pytest.mark.parametrize("n", [1, 2, 61, 150, 20_000])
def test_quantiles_are_exact_at_every_size(spark, n):
    from graphloom.operators.analytics import column_quantiles

    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
    shares = (0.0, 0.0005, 0.05, 0.5, 0.95, 0.98, 0.9999, 1.0)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[:3]], "column_key string, value double")
    got = {r.column_key: r.quantiles for r in column_quantiles(df, shares).collect()}
    assert np.allclose(got["a"], np.quantile(values, shares), rtol=0, atol=1e-12)
    assert np.allclose(got["b"], np.quantile(values[:3], shares), rtol=0, atol=1e-12)


def test_index_hands_on_little(spark, table_, tmp_path, monkeypatch):
    """A row beyond a query's bound is no candidate, and tasks work and hand on in bounded parts."""
    index = VectorIndex.build(table_, f"file://{tmp_path}/index", cells=8)
    asked = vectors.units(table_.filter("vec_id in (20, 40)"), "vec_id", "embedding").select(F.col("id").alias("query_id"), "v")
    probed = index.probes(asked, 8)
    free = index._candidates(probed, 5)
    nearest = free.groupBy("query_id").agg(F.min("most").alias("bound"))
    bound = probed.join(nearest, "query_id").select("query_id", "v", F.col("bound").alias("most"), "cell")
    few = index._candidates(bound, 5)
    assert 2 <= few.count() < free.count() / 4
    assert few.join(nearest, "query_id").filter("least > bound").count() == 0
    monkeypatch.setattr(vectors, "HELD", 64)
    monkeypatch.setattr(vectors, "HANDED", 3)
    assert [len(p) for p in vectors._asks(pd.DataFrame({"query_id": [1, 2], "v": [[1.0]] * 2, "most": [1.0] * 2}), np.array([0, 0, 1, 1]), np.arange(4))] == [3, 1]
    assert max(len(p) for p in vectors._parts(pd.DataFrame({"a": range(40)}), 16)) == 4


@pytest.mark.parametrize("clustered", [False, True])
def test_graph_of_many_dimensions_is_exact(spark, monkeypatch, clustered):
    """Rows without clusters in many dimensions, and rows of which descent found too few, get their true neighbours."""
    monkeypatch.setattr(vectors, "ASKING", 500)
    rows = ROWS[:460] if clustered else [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(1500, 40)))]
    if clustered:
        monkeypatch.setattr(vectors, "RECALL", 1.01)
    k = 7
    got = {}
    for r in neighbour_graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, round(r.score, 6)))
    want = brute(rows, [i for i, _ in rows], k, True)
    assert len(got) == len(rows)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6), q
        assert {i for i, s in got[q] if s > want[q][-1][1] + 2e-6} == {i for i, s in want[q] if s > want[q][-1][1] + 2e-6}


def test_exact_neighbours_shuffle_no_copies(spark, monkeypatch):
    """Four times the rows shuffle about four times as much, however few rows a task holds: no row is sent to several tasks."""
    monkeypatch.setattr(vectors, "ASKING", 50)
    written = lambda: sum(spark._jsc.sc().statusStore().executorList(True).apply(i).totalShuffleWrite() for i in range(spark._jsc.sc().statusStore().executorList(True).size()))
    moved = []
    for n in (750, 3000):
        rows = vectors.units(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(6).normal(size=(n, 32)))], "vec_id long, embedding array<double>"), "vec_id", "embedding")
        before = written()
        assert vectors.exact_neighbours(rows, rows, 3, 32).count() == 3 * n
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved.append(written() - before)
    assert 0 < moved[1] < 4.5 * moved[0], moved
