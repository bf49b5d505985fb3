"""Hierarchies without a matrix: lists of nearest clusters, tiles of points, passes over blocks; against brute force."""

import numpy as np
import pytest

from lookbook.operators import cluster, distance, lists, passes, trees
from test_clustering import brute_merges, by_key, frame


def blobs(seed=5, n=40):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 1.0, (n, 4)) for c in (0, 6, 12)] + [rng.uniform(-20, 30, (n // 2, 4))])


@pytest.mark.parametrize("x", [blobs(), 1.1 ** np.arange(70)[:, None] * np.ones(2), np.concatenate([blobs()[:30], 5 + 1e-9 * blobs(6)[:40]])], ids=["blobs", "chain", "near copies"])
def test_lists_give_wards_heights(x):
    made = trees.ordered(lists.list_merges(x, np.ones(len(x)), "euclidean"), np.ones(len(x)))
    assert np.allclose(made[:, 2], brute_merges(x, "ward"), rtol=1e-8) and made[-1, 3] == len(x)


@pytest.mark.parametrize("kind", [("ward", "euclidean"), ("average", "cosine"), ("average", "euclidean"), ("complete", "cosine")])
def test_one_task_without_a_matrix(kind):
    x = np.concatenate([blobs(), blobs()[:20], blobs()[:5]])  # with copies
    w = np.ones(len(x))
    want, got = trees.merge_tree(x, distance.matrix(x, x, kind[1]), w, *kind[:1]), lists.tree_of(x, w, *kind, 15)
    assert np.allclose(got[:, 2], want[:, 2], atol=1e-6)
    assert all((trees.cut_tree(got, len(x), k) == trees.cut_tree(want, len(x), k)).all() for k in (2, 5, 12))


@pytest.mark.parametrize("kind", [("ward", "euclidean"), ("average", "cosine")])
def test_passes_give_the_same_tree(spark, monkeypatch, kind):
    df = frame(spark, np.concatenate([blobs(n=110), blobs()[:7], blobs()[:7]]))
    want, labels = cluster.merge_table(df, *kind).orderBy("step").collect(), by_key(cluster.agglomerative(df, [2, 3, 9], *kind).collect(), "labels")
    monkeypatch.setattr(cluster, "CAP", 40)  # over eight times as many points go by passes
    monkeypatch.setattr(passes, "NEAR_PAIRS", 20_000)
    searched, real = [], passes._searched
    monkeypatch.setattr(passes, "_searched", lambda *a: searched.append(1) or real(*a))
    got = cluster.merge_table(df, *kind).orderBy("step").collect()
    assert np.allclose([r["height"] for r in got], [r["height"] for r in want], atol=1e-6) and len(got) == len(want)
    assert searched and got[-1]["size"] == df.count() and {r["mode"] for r in got} == {"exact"}
    assert by_key(cluster.agglomerative(df, [2, 3, 9], *kind).collect(), "labels") == labels


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("near", [1, 5])
def test_density_without_a_matrix(metric, near):
    x = blobs()
    w = np.ones(len(x))
    want = trees.density_labels(np.maximum(distance.matrix(x, x, metric), 0), w, 5, near)
    assert (lists.density_rows(x, w, 5, near, 0.0, metric) == want).all() and len(set(want.tolist())) > 1


def test_density_of_some_times_cap_is_one_task(spark, monkeypatch):
    df = frame(spark, blobs())
    want = by_key(cluster.density(df, 5, 5, metric="euclidean").collect(), "cluster")
    monkeypatch.setattr(cluster, "CAP", 40)
    monkeypatch.setattr(cluster, "density_of", None)
    assert by_key(cluster.density(df, 5, 5, metric="euclidean").collect(), "cluster") == want
