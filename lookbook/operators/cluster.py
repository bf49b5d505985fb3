"""Clustering: k-means, agglomerative with merge table, density based; each with its search over k.

Agglomerative and density clustering need all distances of a group, and are exact at every size: a group of up to ``CAP``
points (a hierarchy: some times as many, without a matrix, see ``lists``) is done in one task, a larger one by the passes of
``passes`` or the rounds of ``rounds``. Only a caller who gives ``cap`` gets an approximation:
a group of over ``cap`` points is then first cut into micro-clusters by k-means (``cap`` / 2 of them), whose weighted centroids
stand for the points. ``mode`` in the result says which it was.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distance import cluster_sums, matrix, silhouette, with_labels
from .keep import keep
from .lists import by_means, density_rows, tree_of
from .lloyd import fit, squares
from .rank import strict_k, tolerant_k
from .neighbours import density_by_graph
from .rounds import cut_labels, density_of, merge_steps, merges, numbered
from .trees import cut_tree, density_labels

#: Points of a group, or clusters left of one, whose distances one task holds.
CAP = 4000
#: Times as many points (and doubles of vectors) of a group have their hierarchy made by one task, which then holds no matrix: by means, by points.
ALONE, ALONE_CELLS = (8, 4), 4_000_000
#: Restarts of a k-means model.
RESTARTS = 10
#: Large groups that go by rounds at the same time.
SIDE_BY_SIDE = 4


def kmeans(df: DataFrame, k: int, seed: int = 42, n_init: int = 10, init: str = "k-means||", vec: str = "vec") -> DataFrame:
    """``df`` with ``cluster``: the run of lowest cost among ``n_init`` restarts; null for a null vector."""
    sets = kmeans_sets(df.drop("cluster"), [{"k": k, "n_init": n_init, "init": init}], seed, vec, "_labels")
    return sets.withColumn("cluster", F.get("_labels", F.lit(0))).drop("_labels")


def kmeans_sets(df: DataFrame, configs: list[dict], seed: int = 42, vec: str = "vec", labels: str = "labels") -> DataFrame:
    """``df`` with ``labels``: array<int>, a k-means label for each of ``configs`` (k, n_init 10, init k-means||).

    All restarts of all configs advance by the same passes over the points (``lloyd``); of a config's restarts the lowest cost wins.
    """
    models = [(c["k"], c.get("init", "k-means||"), seed + r) for c in configs for r in range(c.get("n_init", RESTARTS))]
    of, best = [i for i, c in enumerate(configs) for _ in range(c.get("n_init", RESTARTS))], {}
    for i, (centres, cost) in zip(of, fit(df, models, vec), strict=True):
        if i not in best or cost < best[i][1]:
            best[i] = centres, cost
    sent = df.sparkSession.sparkContext.broadcast([best[i][0] for i in range(len(configs))])

    def nearest(vectors: pd.Series) -> pd.Series:
        some = vectors.notna()
        if not some.any():
            return pd.Series([None] * len(vectors))
        x = np.stack(vectors[some]).astype(float)
        middle = x.mean(0)
        found = np.stack([squares(x - middle, c - middle).argmin(1) for c in sent.value], axis=1)
        return pd.Series(list(found.astype(np.int32)), index=vectors.index[some]).reindex(vectors.index, fill_value=None)

    return df.withColumn(labels, F.pandas_udf(nearest, "array<int>")(vec))


def search_kmeans(df: DataFrame, ks: range | list[int], seed: int = 42, n_init: int = 10) -> tuple[DataFrame, DataFrame]:
    """Scores (k, score) and assignments with the best k: all label sets are scored by one pass over distances."""
    ks = list(ks)
    labels = keep(kmeans_sets(df, [{"k": k, "n_init": n_init} for k in ks], seed))
    scores = scored_sets(labels, ks)
    best = strict_k(scores, ["group"]).head()
    chosen = labels.withColumn("cluster", F.get("labels", F.lit(ks.index(best["best_k"]) if best else 0))).drop("labels")
    return scores, chosen


def scored_sets(labels: DataFrame, ks: list[int], group: str | None = None) -> DataFrame:
    """(group, k, score): silhouettes of the label sets of ``labels``, which are those of ``ks`` in order."""
    sil = silhouette(cluster_sums(labels, group=group))
    return sil.select("group", F.get(F.array(*map(F.lit, ks)), F.col("run")).alias("k"), F.col("silhouette").alias("score"))


def _representatives(df: DataFrame, group: str | None, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """(group, rep, vec, weight, mode) and (group, key, rep)."""
    name = F.col(group).cast("string") if group else F.lit("")
    points = df.select(name.alias("group"), F.col("key").cast("string").alias("key"), "vec")
    large = [] if cap is None else [r["group"] for r in points.groupBy("group").count().where(F.col("count") > cap).collect()]  # groups of over ``cap`` points
    exact = points.where(~F.col("group").isin(*large)) if large else points
    reps = exact.select("group", F.col("key").alias("rep"), "vec", F.lit(1.0).alias("weight"), F.lit("exact").alias("mode"))
    members = exact.select("group", "key", F.col("key").alias("rep"))
    for g in large:
        micro = kmeans(points.where(F.col("group") == g), max(2, cap // 2), n_init=1)
        rep = F.lpad(F.col("cluster").cast("string"), 8, "0")
        cells = micro.select(rep.alias("rep"), F.posexplode("vec").alias("i", "x")).groupBy("rep", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
        centres = cells.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vec"), F.max("n").cast("double").alias("weight"))
        reps = reps.unionByName(centres.select(F.lit(g).alias("group"), "rep", "vec", "weight", F.lit("micro-clusters").alias("mode")))
        members = members.unionByName(micro.select("group", "key", rep.alias("rep")))
    return reps, members


def _parted(df: DataFrame, group: str | None, cap: int | None, alone: int = 1) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """``_representatives``, and the points of each group that goes by rounds: without a ``cap``, those of over ``CAP`` points, or ``alone`` times as many
    if their vectors are within the bound."""
    if cap is not None:
        return *_representatives(df, group, cap), {}
    name = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    n, width = F.count("*").alias("n"), F.max(F.size("vec")).alias("width")
    over = (F.col("n") > CAP * alone) | ((F.col("n") > CAP) & (F.col("n") * F.col("width") > ALONE_CELLS))
    large = [r["group"] for r in df.groupBy(name.alias("group")).agg(n, width).where(over).collect()]  # few: groups of over ``CAP`` points
    rest = df.where(~name.isin(*large)) if large else df
    points = {g: df.where(name == g).select(F.col("key").cast("string").alias("key"), "vec") for g in large}
    return *_representatives(rest, group, None), points


def _tree(linkage: str, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    most = CAP
    return lambda x, w: tree_of(x, w, linkage, metric, most)


def _side_by_side(large: dict[str, DataFrame], run: Callable[[str, DataFrame], DataFrame], out: DataFrame) -> DataFrame:
    """``out`` and ``run`` of each large group, some groups at the same time."""
    if not large:
        return out
    with ThreadPool(min(SIDE_BY_SIDE, len(large))) as pool:
        parts = pool.map(inheritable_thread_target(out.sparkSession)(lambda item: run(*item)), list(large.items()))
    return reduce(DataFrame.unionByName, parts, out)


def _arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
    return pdf, np.stack(pdf["vec"]).astype(float), pdf["weight"].to_numpy(float)


def merge_table(df: DataFrame, linkage: str = "ward", metric: str = "euclidean", group: str | None = None, cap: int | None = None) -> DataFrame:
    """(group, step, left, right, height, size, mode): the hierarchy of each group, heights rising."""
    reps, _, large = _parted(df, group, cap, ALONE[not by_means(linkage, metric)])
    tree = _tree(linkage, metric)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, w = _arrays(pdf)
        m = tree(x, w)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "step": range(len(m)), "left": m[:, 0].astype(int), "right": m[:, 1].astype(int), "height": m[:, 2], "size": m[:, 3].astype(int), "mode": pdf["mode"].iloc[0]})

    out = reps.groupBy("group").applyInPandas(run, "group string, step int, left int, right int, height double, size long, mode string")

    def rounds(g: str, rows: DataFrame) -> DataFrame:
        points, n = numbered(rows)
        steps = merge_steps(merges(points, n, linkage, metric, CAP), n)
        return steps.select(F.lit(g).alias("group"), "step", "left", "right", "height", "size", F.lit("exact").alias("mode"))

    return _side_by_side(large, rounds, out)


def agglomerative(df: DataFrame, ks: list[int], linkage: str = "ward", metric: str = "euclidean", group: str | None = None, cap: int | None = None) -> DataFrame:
    """(group, key, labels, mode): the tree of each group, built once and cut at every k."""
    if linkage == "ward" and metric != "euclidean":
        raise ValueError("ward needs euclidean distances")
    reps, members, large = _parted(df, group, cap, ALONE[not by_means(linkage, metric)])
    tree = _tree(linkage, metric)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, w = _arrays(pdf)
        m = tree(x, w)
        cuts = np.stack([cut_tree(m, len(x), k) for k in ks], axis=1)
        return pd.DataFrame({"group": pdf["group"], "rep": pdf["rep"], "labels": list(cuts), "mode": pdf["mode"]})

    cut = reps.groupBy("group").applyInPandas(run, "group string, rep string, labels array<int>, mode string")
    out = members.join(cut, ["group", "rep"]).select("group", "key", "labels", "mode")

    def rounds(g: str, rows: DataFrame) -> DataFrame:
        points, n = numbered(rows)
        labels = cut_labels(points, merges(points, n, linkage, metric, CAP), n, ks)
        return points.join(labels, "idx").select(F.lit(g).alias("group"), "key", "labels", F.lit("exact").alias("mode"))

    return _side_by_side(large, rounds, out)


def search_agglomerative(df: DataFrame, ks: range | list[int] = range(3, 21), group: str | None = None, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (group, k, score) and assignments (group, key, cluster, best_k) by the tolerant choice of k."""
    ks = list(ks)
    labels = keep(agglomerative(df, ks, group=group, cap=cap))
    name = F.col(group).cast("string") if group else F.lit("")
    points = df.select(name.alias("group"), F.col("key").cast("string").alias("key"), "vec").join(labels, ["group", "key"])
    n = F.count("*").over(Window.partitionBy("group"))
    scores = scored_sets(points, ks, "group").join(labels.select("group", n.cast("int").alias("n")).distinct(), "group").where(F.col("k") <= F.greatest(F.col("n") - 2, F.lit(1)))
    best = tolerant_k(scores, ["group"], n="n")
    place = F.array_position(F.array(*map(F.lit, ks)), F.greatest(F.lit(ks[0]), F.coalesce(F.col("best_k").cast("int"), F.lit(ks[0])))).cast("int") - 1
    return scores, labels.join(best, "group", "left").select("group", "key", F.get("labels", place).alias("cluster"), "best_k")


def density(df: DataFrame, min_size: int = 3, min_samples: int = 1, eps: float = 0.0, metric: str = "cosine", group: str | None = None, cap: int | None = None, graph: str | None = None, k: int = 16, probes: int | None = None) -> DataFrame:
    """(group, key, cluster, mode): density clusters, -1 for noise.

    ``graph``: None compares all pairs of a group of over ``CAP`` points; "exact" and "approximate" go by its ``k`` nearest neighbours
    (``neighbours.graph_tree``), with the same clusters (equal distances aside) or, at less cost, those of the ``probes`` lists searched (None: measured).
    """
    if graph not in (None, "exact", "approximate"):
        raise ValueError(f"unknown graph {graph!r}")
    reps, members, large = _parted(df, group, cap, ALONE[1] if graph is None else 1)
    most = CAP

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, w = _arrays(pdf)
        found = density_labels(np.maximum(matrix(x, x, metric), 0), w, min_size, min_samples, eps) if len(x) <= most else density_rows(x, w, min_size, min_samples, eps, metric)
        return pd.DataFrame({"group": pdf["group"], "rep": pdf["rep"], "cluster": found, "mode": pdf["mode"]})

    cut = reps.groupBy("group").applyInPandas(run, "group string, rep string, cluster int, mode string")
    out = members.join(cut, ["group", "rep"]).select("group", "key", "cluster", "mode")

    def rounds(g: str, rows: DataFrame) -> DataFrame:
        points, n = numbered(rows)
        none = points.select("idx", F.lit(-1).alias("cluster"))
        if n < min_size:
            labels = none
        elif graph is None:
            labels = density_of(points, n, min_size, min_samples, eps, metric)
        else:
            labels = density_by_graph(points.select("idx", "vec"), n, min_size, min_samples, eps, metric, k=k, probes=probes, exact=graph == "exact")
        return points.join(labels, "idx").select(F.lit(g).alias("group"), "key", "cluster", F.lit("graph" if graph == "approximate" else "exact").alias("mode"))

    return _side_by_side(large, rounds, out)


__all__ = ["agglomerative", "density", "kmeans", "kmeans_sets", "merge_table", "search_agglomerative", "search_kmeans", "scored_sets", "with_labels"]
