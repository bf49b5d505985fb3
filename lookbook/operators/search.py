"""Searches over configurations, choice of the projection size, comparison of feature sets."""

from __future__ import annotations

import json
import random
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from .blocks import project, standardise
from .cluster import agglomerative, density, kmeans, kmeans_sets
from .distance import cluster_sums, silhouette, with_labels
from .keep import keep
from .rank import best_run
from .scores import composite, score_bundle, score_sets


#: Preprocessings of a random search that are tried at the same time.
SIDE_BY_SIDE = 4


def choose_projection(df: DataFrame, sizes: tuple[int, ...] = (16, 32, 48, 64), fallback: int = 32, seed: int = 42) -> tuple[DataFrame, dict]:
    """The standardised block projected to the size whose 3-means has the best silhouette, and what was done.

    The components of the largest size are computed once; smaller sizes are their prefixes.
    """
    width = df.select(F.size("vec").alias("d")).head()["d"]
    usable = [s for s in sizes if s < width]
    scaled = keep(standardise(df))
    info = {"used_pca": bool(usable), "n_components": width, "original_dim": width, "scaled_dim": width}
    if not usable:
        return scaled, info
    whole = keep(project(scaled, max(usable)))

    def score(size: int) -> float | None:
        cut = kmeans(whole.withColumn("vec", F.slice("vec", 1, size)), 3, seed, n_init=1)
        found = silhouette(cluster_sums(with_labels(cut))).head()
        return found["silhouette"] if found else None

    with ThreadPool(len(usable)) as pool:  # a few candidate sizes, tried side by side
        found = pool.map(inheritable_thread_target(df.sparkSession)(score), usable)
    scores = {s: x for s, x in zip(usable, found, strict=True) if x is not None}
    best = max(sorted(scores), key=scores.get) if scores else min(fallback, max(usable))
    return whole.withColumn("vec", F.slice("vec", 1, best)), info | {"n_components": best, "scaled_dim": best}


def _run_rows(sets: DataFrame, named: list[tuple[str, str, str]]) -> DataFrame:
    """The run table of the label sets of ``sets``; ``named`` has (run_id, algo, params) of each, in order."""
    names = sets.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(named)], "run int, run_id string, algo string, params string")
    return names.join(score_sets(sets), "run").select("run_id", "algo", "params", "n_clusters", "noise_frac", "silhouette", "ch", "db")


def grid_search(df: DataFrame, ks: list[int] = tuple(range(2, 21)), min_sizes: tuple[int, ...] = (5, 10, 20, 30), seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The run table of k-means, Ward and density runs, the best run overall and that of each algorithm.

    One tree serves every k of Ward, and one pass over distances scores the label sets of all runs.
    """
    points, ks = keep(df.select(F.col("key").cast("string").alias("key"), "vec")), list(ks)
    named = [*((f"kmeans-{k:02}", "kmeans", f"k={k}") for k in ks), *((f"ward-{k:02}", "ward", f"k={k}") for k in ks), *((f"density-{m:02}", "density", f"min_size={m}") for m in min_sizes)]
    sets = kmeans_sets(points, [{"k": k} for k in ks], seed).join(agglomerative(points, ks).select("key", F.col("labels").alias("_ward")), "key")
    parts = ["labels", "_ward"]
    for m in min_sizes:
        labels = density(points, m, m, metric="euclidean").select("key", F.array("cluster").alias(f"_density{m}"))
        sets, parts = sets.join(labels, "key"), [*parts, f"_density{m}"]
    sets = keep(sets.select("key", "vec", F.concat(*parts).alias("labels")))
    runs = keep(_run_rows(sets, named))
    return runs, best_run(runs), best_run(runs, ["algo"])


def sample_configs(n: int, most: int, seed: int = 42) -> list[dict]:
    """Seeded configurations; ward forces euclidean distances and only projections to ``most`` dimensions or fewer are drawn."""
    rng, out = random.Random(seed), []
    for i in range(n):
        c = {"trial_id": i, "standardise": rng.random() < 0.5, "l2": rng.random() < 0.5, "pca": rng.choice([None, *(p for p in (32, 64, 128, 256) if p <= most)]), "algo": rng.choice(["kmeans", "agglomerative"]), "k": rng.randint(2, 12)}
        c["linkage"] = rng.choice(["ward", "average", "complete"])
        c["metric"] = "euclidean" if c["linkage"] == "ward" else rng.choice(["euclidean", "cosine"])
        c["init"], c["n_init"] = rng.choice(["k-means||", "random"]), rng.choice([10, 20, 50])
        out.append(c)
    return out


def prepared(df: DataFrame, config: dict) -> DataFrame:
    """(key, vec) as the configuration has them: standardised, of unit length, projected."""
    x = df.select(F.col("key").cast("string").alias("key"), "vec")
    x = standardise(x) if config["standardise"] else x
    x = x.withColumn("vec", l2_normalise(F.col("vec"))) if config["l2"] else x
    return project(x, config["pca"]) if config["pca"] else x


def _label_sets(x: DataFrame, configs: list[dict], seed: int) -> DataFrame:
    """``x`` with ``labels``, one of each config: all k-means fits on one table, one tree for each linkage and metric."""
    flat, place = [c for c in configs if c["algo"] == "kmeans"], {}
    out = kmeans_sets(x, flat, seed, labels="_kmeans") if flat else x
    place |= {c["trial_id"]: F.get("_kmeans", F.lit(i)) for i, c in enumerate(flat)}
    for kind in sorted({(c["linkage"], c["metric"]) for c in configs if c["algo"] != "kmeans"}):
        mine, name = [c for c in configs if c["algo"] != "kmeans" and (c["linkage"], c["metric"]) == kind], "_".join(("", *kind))
        out = out.join(agglomerative(x, [c["k"] for c in mine], *kind).select("key", F.col("labels").alias(name)), "key")
        place |= {c["trial_id"]: F.get(name, F.lit(i)) for i, c in enumerate(mine)}
    return keep(out.select("key", "vec", F.array(*(place[c["trial_id"]] for c in configs)).alias("labels")))


def _trial_scores(x: DataFrame, configs: list[dict], seed: int) -> list[float]:
    """Composite scores; where a config is invalid they are tried one by one, and the invalid ones score -1e9."""
    try:
        scored = score_sets(_label_sets(x, configs, seed)).select("run", composite(F.col("silhouette"), F.col("ch"), F.col("db")).alias("s")).collect()  # a row a config
        by = {r["run"]: float(r["s"]) for r in scored}
        return [by.get(i, -1e9) for i in range(len(configs))]
    except (ValueError, IllegalArgumentException):  # a configuration that this table can't take; a lost or failed job isn't one
        return [-1e9] if len(configs) == 1 else [s for c in configs for s in _trial_scores(x, [c], seed)]


_TRIALS = "features string, trial_id int, config string, score double"


def random_search(df: DataFrame, trials: int = 50, seed: int = 42, name: str = "", store: str | None = None) -> DataFrame:
    """(features, trial_id, config, score) of seeded trials, config as JSON; an invalid configuration scores -1e9, a job that fails fails the search.

    Each preprocessing is made and kept once; all of its trials are scored by one pass over distances. ``SIDE_BY_SIDE``
    preprocessings go at the same time. With ``store``, a folder, each preprocessing's rows are appended there
    when they are done, and a search that was broken off goes on with the trials that the folder doesn't have.
    """
    spark = df.sparkSession
    known = df.agg(F.max(F.size("vec")).alias("d"), F.count("*").alias("n")).head()
    configs, done = sample_configs(trials, min(known["n"] - 1, known["d"] or 0), seed), []
    if store is not None:
        spark.createDataFrame([], _TRIALS).write.mode("append").parquet(store)
        wanted = spark.createDataFrame([(name, c["trial_id"]) for c in configs], "features string, trial_id int")
        done = spark.read.parquet(store).join(wanted, ["features", "trial_id"]).collect()  # a row a trial
    have, by = {r["trial_id"] for r in done}, {}
    for c in configs:
        if c["trial_id"] not in have:
            by.setdefault((c["standardise"], c["l2"], c["pca"]), []).append(c)

    def run(configs: list[dict]) -> list[tuple]:
        x = keep(prepared(df, configs[0]))
        rows = [(name, c["trial_id"], json.dumps({k: v for k, v in c.items() if k != "trial_id"}), s) for c, s in zip(configs, _trial_scores(x, configs, seed), strict=True)]
        x.unpersist()
        if store is not None:
            spark.createDataFrame(rows, _TRIALS).coalesce(1).write.mode("append").parquet(store)
        return rows

    with ThreadPool(max(1, min(SIDE_BY_SIDE, len(by)))) as pool:
        rows = [r for rows in pool.map(inheritable_thread_target(spark)(run), list(by.values())) for r in rows]
    return spark.createDataFrame(sorted([*rows, *((r["features"], r["trial_id"], r["config"], r["score"]) for r in done)]), _TRIALS)


def refit(df: DataFrame, config: str, seed: int = 42) -> DataFrame:
    """(key, cluster): the clustering of a trial's ``config``, fitted again over all points."""
    c = {**json.loads(config), "trial_id": 0}
    return _label_sets(prepared(df, c), [c], seed).select("key", F.get("labels", F.lit(0)).alias("cluster"))


def compare_feature_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """One scored row a feature set; each has (key, vec, cluster)."""
    parts = [score_bundle(df).select(F.lit(name).alias("feature_set"), "n_clusters", "noise_frac", "silhouette", "ch", "db") for name, df in sets.items()]
    return reduce(DataFrame.unionByName, parts)
