"""Many models in one pass, searches with all restarts, wide projections, distances on a grid: against numpy."""

import json

import numpy as np
import pytest

from lookbook.operators import blocks, cluster, distance, lloyd, search, wide
from lookbook.plans import workloads


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(t) for t in p]) for i, p in enumerate(x)], "key long, vec array<double>").repartition(parts, "key")


def blobs(n=60, k=5, d=6, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.uniform(-20, 20, d), 1.0, (n, d)) for _ in range(k)])


def cost_of(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))


def test_all_models_are_fixed_points(spark):
    x = blobs()
    models = [(k, init, s) for k in (1, 2, 5, 7) for init in ("random", "k-means||") for s in (1, 2)]
    fitted = lloyd.fit(frame(spark, x), models)
    for (k, _, _), (centres, cost) in zip(models, fitted, strict=True):
        d2 = ((x[:, None] - centres[None]) ** 2).sum(2)
        own = d2.argmin(1)
        assert len(centres) == k and cost == pytest.approx(d2.min(1).sum())
        shift = sum(((x[own == c].mean(0) - centres[c]) ** 2).sum() for c in range(k) if (own == c).any())
        assert shift <= lloyd.TOLERANCE * x.var(0, ddof=1).mean() + 1e-9
    best = min(cost for (k, _, _), (_, cost) in zip(models, fitted, strict=True) if k == 5)
    assert best == pytest.approx(cost_of(x, np.repeat(np.arange(5), 60)))  # the blobs


def test_models_do_not_depend_on_partitions_or_bounds(spark, monkeypatch):
    x = blobs(40)
    models = [(4, "k-means||", 3), (6, "random", 4)]
    want = lloyd.fit(frame(spark, x, 1), models)
    monkeypatch.setattr(lloyd, "BLOCK", 17)
    for bound in (lloyd.BROADCAST_CELLS, 60):  # model by model, sums added up on Spark
        monkeypatch.setattr(lloyd, "BROADCAST_CELLS", bound)
        got = lloyd.fit(frame(spark, x, 5), models)
        assert all(np.allclose(a[0], b[0]) and np.isclose(a[1], b[1]) for a, b in zip(want, got, strict=True))


def test_more_restarts_never_cost_more(spark):
    x = np.random.default_rng(1).normal(size=(300, 4))
    costs = [c for _, c in lloyd.fit(frame(spark, x), [(9, "random", 42 + s) for s in range(20)])]
    labelled = cluster.kmeans(frame(spark, x), 9, n_init=20, init="random").orderBy("key").collect()
    assert len(set(costs)) > 1 and cost_of(x, np.array([r["cluster"] for r in labelled])) <= min(costs) + 1e-6


def test_kmeans_of_odd_tables(spark):
    same = cluster.kmeans(frame(spark, np.ones((9, 2))), 3).collect()
    assert len(same) == 9 and len({r["cluster"] for r in same}) == 1
    assert cluster.kmeans(frame(spark, np.ones((1, 2))), 3).head()["cluster"] == 0
    some = spark.createDataFrame([(1, [0.0, 1.0], "x"), (2, None, "y"), (3, [5.0, 5.0], "z")], "key long, vec array<double>, cluster string")
    got = {r["key"]: r["cluster"] for r in cluster.kmeans(some, 2).collect()}
    assert got[2] is None and {got[1], got[3]} == {0, 1}
    assert cluster.kmeans(some.limit(0), 2).collect() == []


def test_registered_searches_have_all_restarts(spark, monkeypatch):
    from lookbook.plans import registry

    seen = []

    def stub(df, configs, *a, **b):
        seen.append([c.get("n_init", cluster.RESTARTS) for c in configs])
        raise RuntimeError("seen")

    monkeypatch.setattr(cluster, "kmeans_sets", stub)
    monkeypatch.setattr(search, "kmeans_sets", stub)
    for name, runs in (("kmeans", 1), ("kmeans_search", 10), ("grid_search", 19)):
        with pytest.raises(RuntimeError, match="seen"):
            registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert seen.pop() == [10] * runs
    drawn = search.sample_configs(200, 40)
    assert {c["n_init"] for c in drawn} == {10, 20, 50} and {c["pca"] for c in drawn} == {None, 32}
    assert {c["pca"] for c in search.sample_configs(200, 256)} == {None, 32, 64, 128, 256}


def test_a_broken_off_search_goes_on(spark, monkeypatch, tmp_path):
    df, store = frame(spark, blobs(12, 3, 4)), str(tmp_path / "trials")
    want = search.random_search(df, 8).collect()
    real, calls = search._trial_scores, []

    def breaks(x, configs, seed):
        calls.append(len(configs))
        if len(calls) > 2:
            raise RuntimeError("executor lost")
        return real(x, configs, seed)

    monkeypatch.setattr(search, "SIDE_BY_SIDE", 1)
    monkeypatch.setattr(search, "_trial_scores", breaks)
    with pytest.raises(RuntimeError):
        search.random_search(df, 8, store=store)
    done = spark.read.parquet(store).count()
    assert 0 < done < 8
    again = []
    monkeypatch.setattr(search, "_trial_scores", lambda x, c, s: again.append(len(c)) or real(x, c, s))
    got = search.random_search(df, 8, store=store).collect()
    assert sum(again) == 8 - done and [(r["trial_id"], r["config"]) for r in got] == [(r["trial_id"], r["config"]) for r in want]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in want])
    assert search.random_search(df, 8, store=store).count() == 8 and sum(again) == 8 - done


def test_the_best_trial_is_fitted_again(spark):
    tables = {"a": frame(spark, blobs(12, 3, 4)), "b": frame(spark, np.random.default_rng(3).normal(size=(36, 4)))}
    trials, best = workloads.configuration_search(tables, 6)
    assert trials.count() == 12 and best.count() == 2
    top = max(best.collect(), key=lambda r: r["score"])
    out = workloads.best_assignments(tables, best).collect()
    assert len(out) == 36 and {r["features"] for r in out} == {top["features"]} and len({r["cluster"] for r in out}) == json.loads(top["config"])["k"]


@pytest.mark.parametrize("rows", [4096, 0])
def test_wide_projection_equals_numpy(spark, monkeypatch, rows):
    monkeypatch.setattr(wide, "GRAM_ROWS", rows)
    monkeypatch.setattr(wide, "BAND_CELLS", 200_000)
    monkeypatch.setattr(wide, "BLOCK_CELLS", 150_000)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12)) * np.geomspace(30, 1, 12) @ rng.normal(size=(12, 8000)) + rng.normal(size=(90, 8000)) * 0.01 + 3
    out = blocks.project(frame(spark, x, 4), 8).orderBy("key").collect()
    _, _, turned = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ turned[:8].T
    assert np.allclose(np.abs(np.array([r["vec"] for r in out])), np.abs(want), rtol=1e-6, atol=1e-5)


def test_wide_and_narrow_ways_agree(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(50, 10)) * np.arange(1, 11)
    want = np.abs(np.array([r["vec"] for r in blocks.project(frame(spark, x), 4).orderBy("key").collect()]))
    monkeypatch.setattr(blocks, "WIDE", 5)
    for rows in (4096, 0):
        monkeypatch.setattr(wide, "GRAM_ROWS", rows)
        assert np.allclose(np.abs(np.array([r["vec"] for r in blocks.project(frame(spark, x), 4).orderBy("key").collect()])), want, atol=1e-6)
    few = blocks.project(frame(spark, x[:3]), 4).collect()  # two components have no variance
    assert len(few) == 3 and all(len(r["vec"]) == 4 for r in few)


def test_distances_on_a_grid_equal_one_block(spark):
    x = np.random.default_rng(7).normal(size=(120, 5))
    labels = [[i % 3, -1 if i % 7 == 0 else i % 2] for i in range(120)]
    df = spark.createDataFrame([(i, [float(t) for t in p], labels[i], "big" if i < 100 else None if i < 110 else "small") for i, p in enumerate(x)], "key long, vec array<double>, labels array<int>, brand string")
    for metric in ("euclidean", "cosine"):
        want = {tuple(r)[:5]: (r["dist_sum"], r["n_pairs"]) for r in distance.cluster_sums(df, group="brand", metric=metric).collect()}
        for block in (40, 9, 2):
            rows = distance.cluster_sums(df, group="brand", metric=metric, block=block).collect()
            got = {tuple(r)[:5]: (r["dist_sum"], r["n_pairs"]) for r in rows}
            assert len(rows) == len(got) and got.keys() == want.keys()
            assert all(np.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_bands_grow_with_the_root_of_the_points():
    assert distance.bands(2000, 64, 8) == 1 and distance.bands(4001, 64, 8) == 3
    assert distance.bands(10**6, 64, 8) == 23 and distance.bands(10**8, 64, 8) == 800  # held bands are bounded


def test_squared_silhouette_equals_all_pairs(spark):
    from lookbook.operators import scores

    x = np.random.default_rng(9).normal(size=(70, 4)) + np.repeat([0, 3, 9], [30, 39, 1])[:, None]
    sets = [[0 if i < 30 else 1 if i < 69 else 2, -1 if i % 9 == 0 else i % 2, 5] for i in range(70)]
    df = spark.createDataFrame([(i, [float(t) for t in p], sets[i], "b" if i % 5 else None) for i, p in enumerate(x)], "key long, vec array<double>, labels array<int>, brand string")
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)

    def brute(rows, run):
        rows = [i for i in rows if sets[i][run] >= 0]
        y = np.array([sets[i][run] for i in rows])
        if len(set(y)) < 2:
            return None
        d, s = d2[np.ix_(rows, rows)], []
        for i, c in enumerate(y):
            own = (y == c) & (np.arange(len(y)) != i)
            b = min(d[i, y == k].mean() for k in set(y) if k != c)
            s.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0)
        return np.mean(s)

    for group, parts in ((None, {"": range(70)}), ("brand", {"b": [i for i in range(70) if i % 5], None: range(0, 70, 5)})):
        got = {(r["group"], r["run"]): r["silhouette"] for r in scores.squared_silhouette(df, group=group).collect()}
        assert len(got) == 3 * len(parts)
        for (g, run), s in got.items():
            want = brute(list(parts[g]), run)
            assert s is None if want is None else s == pytest.approx(want), (g, run)
    assert scores.squared_silhouette(df.limit(0)).collect() == []


def test_grouped_vector_aggregates(spark):
    x = np.random.default_rng(10).normal(size=(40, 6)) * np.arange(6)
    df = spark.createDataFrame([(i, [float(t) for t in p], "a" if i < 25 else "b" if i < 39 else "c", i % 3 - 1) for i, p in enumerate(x)], "key long, vec array<double>, brand string, cluster int")
    got = {r["key"]: r["vec"] for r in blocks.standardise(df, group="brand").collect()}
    for rows in (range(25), range(25, 39), range(39, 40)):
        part = x[list(rows)]
        std = part.std(0)
        want = np.where(std > 0, (part - part.mean(0)) / np.where(std > 0, std, 1), 0)
        assert np.allclose([got[i] for i in rows], want)
    centres = {(r["brand"], r["cluster"]): (r["n"], r["centroid"]) for r in blocks.centroids(df, group="brand").collect()}
    assert set(centres) == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}  # c has noise only
    rows = [i for i in range(25) if i % 3 == 1]
    assert centres["a", 0][0] == len(rows) and np.allclose(centres["a", 0][1], x[rows].mean(0))


def test_failed_rows_keep_key_and_reason(spark):
    from lookbook.sources import scoring

    def make():
        def model(batch):
            if 13 in batch:
                raise ValueError("thirteen")
            return [None if v == 5 else [v] for v in batch]

        return model

    rows = spark.range(40).selectExpr("id k", "id x").coalesce(1)
    got = {r["key"]: (r["vec"], r["error"]) for r in scoring.score_rows(rows, "k", "x", make, 4).collect()}
    assert len(got) == 40 and got[13] == (None, "ValueError: thirteen") and got[5] == (None, scoring.NO_OUTPUT)
    assert all(got[i] == ([float(i)], None) for i in range(40) if i not in (5, 13))

    def broken():
        def model(batch):
            raise ValueError("no weights")

        return model

    with pytest.raises(Exception, match="no weights"):
        scoring.score_rows(rows, "k", "x", broken, 4).collect()
    assert scoring.score_rows(rows.limit(0), "k", "x", make).collect() == []


def test_distances_are_made_in_tiles(spark, monkeypatch):
    x = np.random.default_rng(11).normal(size=(150, 5))
    labels = [[i % 3, -1 if i % 7 == 0 else i % 90] for i in range(150)]  # few and many clusters
    df = spark.createDataFrame([(i, [float(t) for t in p], labels[i]) for i, p in enumerate(x)], "key long, vec array<double>, labels array<int>")
    d, got = np.linalg.norm(x[:, None] - x[None], axis=2), {}
    monkeypatch.setattr(distance, "BATCH", 16)
    for block in (2000, 40):
        rows = distance.cluster_sums(df, block=block).collect()
        got = {(r["run"], int(r["key"]), r["other"]): (r["dist_sum"], r["n_pairs"]) for r in rows}
        assert len(got) == len(rows)
        for run in (0, 1):
            y = np.array([s[run] for s in labels])
            for i in np.flatnonzero(y >= 0):
                for c in set(y[y >= 0].tolist()):
                    member = (y == c) & (np.arange(150) != i)
                    assert ((run, i, c) in got) == bool(member.any())
                    if member.any():
                        assert np.isclose(got[run, i, c][0], d[i, member].sum()) and got[run, i, c][1] == member.sum()


def test_no_tile_is_larger_than_a_batch(monkeypatch):
    import pandas as pd

    seen, real = [], distance.matrix
    monkeypatch.setattr(distance, "matrix", lambda a, b, metric="euclidean": seen.append((len(a), len(b))) or real(a, b, metric))
    n, x = 5000, np.random.default_rng(12).normal(size=(5000, 3))
    part = pd.DataFrame({"own": [0] * (n // 2) + [1] * (n // 2), "key": [str(i) for i in range(n)], "vec": list(x), "labels": [[i % 4] for i in range(n)]})
    pair = distance._BandSums(("", 0, 1), "euclidean")
    rows = pd.concat([*pair.add(part), *pair.rows()])
    assert max(max(s) for s in seen) <= distance.BATCH and rows["n_pairs"].sum() == 2 * (n // 2) ** 2
