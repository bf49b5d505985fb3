"""Neighbours and density clusters over their graph, against numpy and the way that compares all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookbook.operators import cluster, neighbours, rounds
from lookbook.operators.distance import matrix


@pytest.fixture
def lists_only(monkeypatch):
    """Small tables fit one band, where the grid is always cheaper: search the lists all the same."""
    monkeypatch.setattr(neighbours, "bands", lambda *_: 10_000)


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(t) for t in p]) for i, p in enumerate(x)], "key long, vec array<double>").repartition(parts, "key")


def blobs(n, k, d, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.uniform(-20, 20, d), rng.uniform(0.5, 3), (n, d)) for _ in range(k)])


def found(df):
    out = {}
    for r in df.orderBy("key", "rank").collect():
        out.setdefault(r["key"], []).append((r["to"], r["d"]))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours(spark, metric, monkeypatch, lists_only):
    monkeypatch.setattr(neighbours, "BLOCK", 50)  # lists over several blocks and parts
    monkeypatch.setattr(neighbours, "ASKED", 90)
    x = np.concatenate([blobs(150, 5, 8), np.zeros((3, 8))])
    d = np.maximum(matrix(x, x, metric), 0)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :10]
    exact = found(neighbours.neighbours(frame(spark, x), 10, metric, probes=2, exact=True))
    assert all(np.allclose([v for _, v in exact[i]], want[i], atol=1e-6) for i in range(len(x)))
    assert all(abs(d[i, j] - v) < 1e-6 for i, row in exact.items() for j, v in row)
    near = found(neighbours.neighbours(frame(spark, x), 10, metric))
    right = sum(sum(v <= want[i, -1] + 1e-6 for _, v in near[i]) for i in near)
    assert all(len(row) == 10 for row in near.values()) and right >= 0.9 * 10 * len(x)


def test_all_pairs_where_lists_rule_nothing_out(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 24))
    asked = []
    monkeypatch.setattr(neighbours, "_by_grid", lambda index, k, real=neighbours._by_grid: asked.append(k) or real(index, k))
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    got = found(neighbours.neighbours(frame(spark, x), 6, exact=True))
    d = matrix(x, x)
    np.fill_diagonal(d, np.inf)
    assert asked == [7] and all(np.allclose([v for _, v in got[i]], np.sort(d[i])[:6], atol=1e-6) for i in range(len(x)))


def test_few_points(spark):
    for x in (np.zeros((0, 2)), np.ones((1, 2)), np.ones((4, 2))):
        got = found(neighbours.neighbours(frame(spark, x, 1), 5))
        assert [len(v) for v in got.values()] == ([3] * 4 if len(x) == 4 else [])
    with pytest.raises(ValueError, match="metric"):
        neighbours.neighbours(frame(spark, np.ones((2, 2))), 1, "manhattan")


def labels_of(df, column="cluster"):
    return {r["idx"]: r[column] for r in df.collect()}


@pytest.mark.parametrize(("metric", "min_samples"), [("euclidean", 5), ("cosine", 1)])
def test_exact_graph_is_the_least_tree(spark, metric, min_samples, lists_only):
    x = np.concatenate([blobs(90, 4, 5, 3), np.repeat([[1.0, 2, 3, 4, 5]], 70, axis=0), np.repeat([[9.0, -2, 3, 4, 5]], 30, axis=0)])  # copies
    points, n = rounds.numbered(frame(spark, x).withColumn("key", F.col("key").cast("string")))
    want_edges, want_core = rounds.spanning_tree(points, n, min_samples, metric)
    edges, core = neighbours.graph_tree(points.select("idx", "vec"), n, min_samples, metric, k=8, probes=3, exact=True)
    assert edges.count() == n - 1
    assert np.allclose(sorted(r["w"] for r in edges.collect()), sorted(r["w"] for r in want_edges.collect()), atol=1e-6)
    got, want = labels_of(core, "core"), labels_of(want_core, "core")
    assert got.keys() == want.keys() and np.allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(want)], atol=1e-6)
    if metric == "cosine":
        return
    rough, _ = neighbours.graph_tree(points.select("idx", "vec"), n, min_samples, metric, k=8, probes=2)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in rough.collect():  # spans all points, without a ring
        a, b = find(r["a"]), find(r["b"])
        assert a != b
        root[a] = b
    assert rough.count() == n - 1


def test_density_of_a_large_group(spark, monkeypatch):
    x = blobs(80, 6, 6, 7)
    df = frame(spark, x)
    get = lambda rows: {r["key"]: r["cluster"] for r in rows.collect()}
    want = get(cluster.density(df, 5, 3, metric="euclidean"))
    monkeypatch.setattr(cluster, "CAP", 100)
    assert get(cluster.density(df, 5, 3, metric="euclidean", graph="exact")) == want
    rough = cluster.density(df, 5, 3, metric="euclidean", graph="approximate")
    got = get(rough)
    assert {r["mode"] for r in rough.collect()} == {"graph"} and np.mean([got[i] == want[i] for i in want]) >= 0.9
    with pytest.raises(ValueError, match="graph"):
        cluster.density(df, graph="other")
