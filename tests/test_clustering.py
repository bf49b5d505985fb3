"""Vectors, distances, scores and clustering against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookbook.functions import vectors as v
from lookbook.operators import blocks, cluster, distance, minsize, rank, rounds, scores, search, trees
from lookbook.operators import pixels as px


def frame(spark, x, labels=None, groups=None):
    rows = [(i, [float(t) for t in p], int(labels[i]) if labels is not None else 0, "g" if groups is None else groups[i]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "key long, vec array<double>, cluster int, brand string")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.6, (12, 3)) for c in (0, 3, 7)] + [rng.normal(20, 0.1, (1, 3)), rng.normal(3, 4, (4, 3))])
    return x, np.array([0] * 12 + [1] * 12 + [2] * 12 + [3] + [-1] * 4)


def brute(x, y):
    keep = y >= 0
    x, y = x[keep], y[keep]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    ks = np.unique(y)
    s = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        b = min(d[i, y == k].mean() for k in ks if k != y[i])
        a = d[i, own].mean() if own.any() else None
        s.append(0 if a is None else (b - a) / max(a, b))
    c = {k: x[y == k].mean(0) for k in ks}
    w = sum(((x[y == k] - c[k]) ** 2).sum() for k in ks)
    bt = sum((y == k).sum() * ((c[k] - x.mean(0)) ** 2).sum() for k in ks)
    ch = bt * (len(x) - len(ks)) / (w * (len(ks) - 1))
    m = {k: np.linalg.norm(x[y == k] - c[k], axis=1).mean() for k in ks}
    db = np.mean([max((m[i] + m[j]) / np.linalg.norm(c[i] - c[j]) for j in ks if j != i) for i in ks])
    return np.mean(s), ch, db


@pytest.mark.parametrize("block", [2000, 7])
def test_scores(spark, data, block):
    x, y = data
    df = frame(spark, x, y)
    sums = distance.cluster_sums(distance.with_labels(df), block=block)
    sil, ch, db = brute(x, y)
    assert distance.silhouette(sums).head()["silhouette"] == pytest.approx(sil)
    got = scores.score_bundle(df).head()
    assert (got["n_clusters"], got["noise_frac"]) == (4, pytest.approx(4 / 41))
    assert (got["silhouette"], got["ch"], got["db"]) == (pytest.approx(sil), pytest.approx(ch), pytest.approx(db))
    one = scores.score_bundle(df.where("cluster = 1")).head()
    assert one["silhouette"] is None and one["ch"] is None and one["db"] is None
    none = scores.score_bundle(df.where("cluster = -1")).head()
    assert none["n_clusters"] == 0 and none["silhouette"] is None


def test_separation_and_ranks(spark, data):
    x, y = data
    sets = distance.with_labels(frame(spark, x, y))
    sums, sizes = distance.cluster_sums(sets, block=9), distance.label_sets(sets)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    sep = {(h, f): d[np.ix_(y == h, y == f)].mean() for h in range(4) for f in range(4) if h != f}
    got = {r["cluster"]: r for r in distance.cluster_separation(distance.pair_separation(sums), sizes).collect()}
    for h in range(4):
        mine = {f: sep[h, f] for f in range(4) if f != h}
        assert got[h]["min_sep"] == pytest.approx(min(mine.values())) and got[h]["min_pair"] == min(mine, key=mine.get)
        assert got[h]["mean_sep"] == pytest.approx(np.mean(list(mine.values()))) and got[h]["max_pair"] == max(mine, key=mine.get)
    total = {(r["h"], r["f"]): r["sep"] for r in distance.pair_separation(sums, "sum").collect()}
    assert total[0, 1] == pytest.approx(d[np.ix_(y == 0, y == 1)].sum())
    disp = {r["cluster"]: r["dispersion"] for r in distance.dispersion(sums, sizes).collect()}
    assert disp[3] == 0 and disp[0] == pytest.approx(d[np.ix_(y == 0, y == 0)].sum() / (12 * 11)) and -1 not in disp
    ranks = rank.rank_clusters(distance.cluster_separation(distance.pair_separation(sums), sizes), "min_sep", "min_pair")
    order = sorted(range(4), key=lambda h: (-min(sep[h, f] for f in range(4) if f != h), h))
    assert [r["cluster"] for r in ranks.orderBy("rank").collect()] == order
    new = {r["key"]: r["cluster"] for r in rank.relabel(frame(spark, x, y), ranks).collect()}
    assert all(new[i] == (order.index(c) if c >= 0 else -1) for i, c in enumerate(y))
    lone = distance.with_labels(frame(spark, x[:3], [5, 5, 5]))
    alone = distance.cluster_separation(distance.pair_separation(distance.cluster_sums(lone)), distance.label_sets(lone)).head()
    assert (alone["min_sep"], alone["min_pair"]) == (0.0, None)


def test_blocks(spark, data):
    x, _ = data
    wide = np.column_stack([x, np.ones(len(x))])
    df = frame(spark, wide, groups=["a" if i % 3 else "b" for i in range(len(x))])
    got = np.array([r["vec"] for r in blocks.standardise(df).orderBy("key").collect()])
    want = np.column_stack([(x - x.mean(0)) / x.std(0), np.zeros(len(x))])
    assert np.allclose(got, want)
    by = {r["key"]: r["vec"] for r in blocks.standardise(df, group="brand").collect()}
    part = x[[i for i in range(len(x)) if i % 3]]
    assert np.allclose(by[1][:3], (x[1] - part.mean(0)) / part.std(0))
    assert blocks.project(df, 9).columns == df.columns and blocks.project(df, 9).head()["vec"] == df.head()["vec"]
    p = np.array([r["vec"] for r in blocks.project(frame(spark, want[:, :3]), 2).orderBy("key").collect()])
    u, s, _ = np.linalg.svd(want[:, :3], full_matrices=False)
    assert np.allclose(np.abs(p), np.abs(u[:, :2] * s[:2]))
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = one.select(v.l2_normalise(F.col("a")), v.l2_normalise(F.col("b")), v.distance(F.col("a"), F.col("b")), v.distance(F.col("a"), F.col("b"), "cosine"), v.weighted_concat((F.col("a"), 2), (F.col("b"), 1))).head()
    assert row[:] == ([0.6, 0.8], [0.0, 0.0], 5.0, 1.0, [6.0, 8.0, 0.0, 0.0])


def test_min_size(spark, data):
    x, y = data
    df = frame(spark, x, y)
    cut = {r["key"]: r["cluster"] for r in minsize.enforce_min_size(df).collect()}
    assert all(cut[i] == (c if c in (0, 1, 2) else -1) for i, c in enumerate(y))
    merged = {r["key"]: r["cluster"] for r in minsize.enforce_min_size(df, merge=True).collect()}
    c = np.array([x[y == k].mean(0) for k in range(3)])
    assert all(merged[i] == (y[i] if y[i] in (0, 1, 2) else int(np.argmin(((x[i] - c) ** 2).sum(1)))) for i in range(len(y)))
    assert {r["cluster"] for r in minsize.enforce_min_size(df, 100).collect()} == {-1}


def brute_merges(x, linkage):
    groups, d, heights = [[i] for i in range(len(x))], np.linalg.norm(x[:, None] - x[None], axis=2), []

    def dist(a, b):
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return d[np.ix_(a, b)].mean() if linkage == "average" else d[np.ix_(a, b)].max()

    while len(groups) > 1:
        h, i, j = min((dist(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        groups[j] = groups[j] + groups.pop(i)
    return heights


@pytest.mark.parametrize("linkage", ["ward", "average", "complete"])
def test_merge_tree(spark, data, linkage):
    x, _ = data
    m = trees.merge_tree(x, distance.matrix(x, x), np.ones(len(x)), linkage)
    assert np.allclose(m[:, 2], brute_merges(x, linkage)) and m[-1, 3] == len(x)
    cut = trees.cut_tree(m, len(x), 4)
    assert len(set(cut)) == 4 and len(set(cut[:12])) <= 2
    got = cluster.merge_table(frame(spark, x), linkage).orderBy("step").collect()
    assert np.allclose([r["height"] for r in got], m[:, 2]) and got[-1]["size"] == len(x)
    doubled = trees.merge_tree(x, distance.matrix(x, x), np.full(len(x), 2.0), "ward")
    assert np.allclose(doubled[:, 2], np.sqrt(2) * np.array(brute_merges(x, "ward")))


def test_agglomerative_groups_and_micro_clusters(spark, data):
    x, _ = data
    groups = ["a"] * 36 + ["b", "c", "c", "c", "c"]
    rows = cluster.agglomerative(frame(spark, x, groups=groups), [1, 3], group="brand").collect()
    assert len(rows) == len(x) and {r["mode"] for r in rows} == {"exact"}
    a = {int(r["key"]): r["labels"][1] for r in rows if r["group"] == "a"}
    assert all(len({a[i] for i in range(s, s + 12)}) == 1 for s in (0, 12, 24))
    micro = cluster.agglomerative(frame(spark, x[:36]), [3], cap=30).collect()
    assert {r["mode"] for r in micro} == {"micro-clusters"} and len(micro) == 36
    assert all(len({r["labels"][0] for r in micro if int(r["key"]) // 12 == s}) == 1 for s in range(3))
    with pytest.raises(ValueError):
        cluster.agglomerative(frame(spark, x), [3], "ward", "cosine")


def test_searches(spark, data):
    x, _ = data
    df = frame(spark, x[:36]).drop("cluster", "brand")
    table, chosen = cluster.search_kmeans(df, range(2, 6))
    assert rank.strict_k(table, ["group"]).head()["best_k"] == 3
    assert chosen.select("cluster").distinct().count() == 3
    _, labelled = cluster.search_agglomerative(df, range(3, 8))
    assert {r["best_k"] for r in labelled.collect()} <= {3, 4, 5, 6, 7}
    runs, best, per = search.grid_search(df, [2, 3], (5,))
    assert best.head()["n_clusters"] == 3 and {r["algo"] for r in per.collect()} == {"kmeans", "ward", "density"}
    trials = search.random_search(df, 3).collect()
    assert len(trials) == 3 and all(t["score"] > -1e9 or "pca" in t["config"] for t in trials)
    assert search.sample_configs(50, 100) == search.sample_configs(50, 100)
    _, info = search.choose_projection(df, (2, 16), 2)
    assert info == {"used_pca": True, "n_components": 2, "original_dim": 3, "scaled_dim": 2}
    both = search.compare_feature_sets({"a": frame(spark, x, data[1]), "b": frame(spark, -2 * x, data[1])}).orderBy("feature_set").collect()
    assert both[0]["silhouette"] == pytest.approx(both[1]["silhouette"])


def test_density(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (15, 2)), [[2.5, 40.0], [-60.0, 3.0]]])
    got = {int(r["key"]): r["cluster"] for r in cluster.density(frame(spark, x), 5, 2, metric="euclidean").collect()}
    assert [got[i] for i in range(37)] == [0] * 20 + [1] * 15 + [-1] * 2
    assert {r["cluster"] for r in cluster.density(frame(spark, x[:3]), 5, 2).collect()} == {-1}
    shuffled = np.random.default_rng(2).permutation(37)
    again = {int(shuffled[int(r["key"])]): r["cluster"] for r in cluster.density(frame(spark, x[shuffled]), 5, 2, metric="euclidean").collect()}
    assert len({(got[i], again[i]) for i in range(37)}) == 3


def image(spark, grid, stem="s"):
    return spark.createDataFrame([(stem, y, x, *p) for y, row in enumerate(grid) for x, p in enumerate(row)], "stem string, y int, x int, r int, g int, b int")


def test_pixels(spark):
    white, black, warm = (255, 255, 255), (0, 0, 0), (200, 120, 20)
    grid = [[white] * 10 for _ in range(10)]
    for y in range(4, 6):
        for x in range(3, 8):
            grid[y][x] = black if x < 6 else warm
    df = image(spark, grid)
    hist = np.array(px.colour_histogram(df).head()["vec"])
    assert len(hist) == 96 and np.linalg.norm(hist) == pytest.approx(1) and hist[31] > 0.5
    assert px.object_box(df, px.dark_pixel(), 1).head()[1:] == (2, 3, 8, 6)
    assert px.object_box(image(spark, [[white] * 3] * 2), px.dark_pixel()).head()[1:] == (0, 0, 2, 1)
    assert px.crop(df, px.object_box(df, px.dark_pixel(), 0)).count() == 10
    assert px.whiten(image(spark, [[(251, 251, 251), (250, 250, 250)]])).orderBy("x").head()["r"] == 255
    mask = df.select("stem", "y", "x", F.when(F.col("r") < 255, 9).otherwise(0).alias("alpha"))
    assert px.alpha_box(mask).head()[1:] == (3, 4, 7, 5)
    assert px.merge_masks(mask, mask.withColumn("alpha", F.lit(5))).agg(F.min("alpha"), F.max("alpha")).head()[:] == (5, 9)
    m = px.shape_moments(df).head()
    assert m["area"] == 10 and m["hu1"] == pytest.approx((20 + 2.5) / 100)
    assert m["axis_ratio"] == pytest.approx(np.sqrt((2 + 1 / 12) / (0.25 + 1 / 12)))
    flat = px.shape_moments(image(spark, [[black] * 3] * 3)).head()
    assert flat["area"] is None and flat["hu1"] is None
    q = px.full_descriptors(df).head()
    inner = [p for row in grid for p in row]
    assert q["brightness"] == pytest.approx(np.mean([max(p) for p in inner]) / 255)
    assert q["aspect_ratio"] == 2.5 and q["circularity"] == 0.4
    means = minsize.describe_clusters(px.full_descriptors(df).withColumn("cluster", F.lit(1)))
    assert minsize.name_clusters(means).head()["name"].startswith("Slim Rectangle")


@pytest.mark.parametrize("bound", [4_000_000, 40])
def test_nearest_centroid(spark, data, monkeypatch, bound):
    monkeypatch.setattr(blocks, "BROADCAST_CELLS", bound)
    x, y = data
    points = frame(spark, x, y)
    centres = {c: x[y == c].mean(axis=0) for c in range(4)}
    got = {r["key"]: (r["nearest"], r["dist2"]) for r in blocks.nearest_centroid(points, blocks.centroids(points)).collect()}
    assert len(got) == len(x)
    for i, p in enumerate(x):
        d, c = min((float(((p - m) ** 2).sum()), c) for c, m in centres.items())
        assert got[i][0] == c and abs(got[i][1] - d) < 1e-9


def by_key(rows, column):
    return [r[column] for r in sorted(rows, key=lambda r: r["key"])]


def test_large_groups_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, (60, 4)) for c in (0, 6, 12)] + [rng.uniform(-20, 30, (30, 4))])
    df = frame(spark, x)
    kinds = [("ward", "euclidean"), ("average", "cosine"), ("complete", "euclidean")]
    want = {k: cluster.merge_table(df, *k).orderBy("step").collect() for k in kinds}
    cuts = by_key(cluster.agglomerative(df, [3, 9]).collect(), "labels")
    dense = {m: by_key(cluster.density(df, 5, m, metric="euclidean").collect(), "cluster") for m in (1, 5)}
    assert all(-1 in d and len(set(d)) > 2 for d in dense.values())
    monkeypatch.setattr(cluster, "CAP", 40)
    for f, name in ((rounds.merges, "merges"), (rounds.density_of, "density_of")):
        monkeypatch.setattr(cluster, name, lambda *a, f=f: f(*a, block=25))  # clusters of over 25 points are split over bands
    for k, steps in want.items():
        got = cluster.merge_table(df, *k).orderBy("step").collect()
        assert [(r["left"], r["right"], r["size"], r["mode"]) for r in got] == [(r["left"], r["right"], r["size"], "exact") for r in steps], k
        assert np.allclose([r["height"] for r in got], [r["height"] for r in steps]), k
    assert by_key(cluster.agglomerative(df, [3, 9]).collect(), "labels") == cuts
    for m, labels in dense.items():
        assert by_key(cluster.density(df, 5, m, metric="euclidean").collect(), "cluster") == labels, m
