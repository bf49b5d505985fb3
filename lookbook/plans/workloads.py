"""The three workloads, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, catalog, cluster, distance, rank, search
from ..operators.keep import keep


def price_intelligence(products: DataFrame, assignments: DataFrame, low: float, high: float, key: str = "join_key") -> DataFrame:
    """Clean prices in a range, joined with clusters, summed up per brand and cluster with display text."""
    kept = catalog.in_range(catalog.priced(products), low, high)
    stats = catalog.price_premium(catalog.assigned_prices(assignments, kept, key))
    return stats.withColumn("label", text.stats_text(F.col("min_price"), F.col("mean_price"), F.col("max_price"))).withColumn("title", text.cluster_title(F.col("cluster"), F.col("n")))


def families(shape: DataFrame, colour: DataFrame, texture: DataFrame, ks: range | list[int] = range(3, 21), shape_weight: float = 4.0) -> DataFrame:
    """(key, cluster, best_k): weighted blocks, Ward with a tolerant choice of k, clusters named by how far apart they are."""
    colour, texture = map(keep, (colour, texture))  # read for their scale and again for the blocks
    projected, _ = search.choose_projection(shape)
    points = blocks.join_blocks("key", (projected.select("key", "vec"), shape_weight), (blocks.standardise(colour), 1.0), (blocks.standardise(texture), 1.0))
    points = keep(points)  # read by every k and by the ranking
    _, chosen = cluster.search_agglomerative(points, ks)
    labelled = keep(points.withColumn("key", F.col("key").cast("string")).join(chosen.select("key", "cluster", "best_k"), "key"))
    return ranked_families(labelled)


def ranked_families(labelled: DataFrame, order_by: str = "separation", stat: str = "min_sep") -> DataFrame:
    """Relabelled by separation (or dispersion), largest first; noise stays -1."""
    sets = distance.with_labels(labelled)
    sums, sizes = distance.cluster_sums(sets), distance.label_sets(sets)
    if order_by == "separation":
        ranks = rank.rank_clusters(distance.cluster_separation(distance.pair_separation(sums), sizes), stat)
    else:
        ranks = rank.rank_clusters(distance.dispersion(sums, sizes), "dispersion")
    return rank.relabel(labelled, ranks)


def configuration_search(tables: dict[str, DataFrame], trials: int = 50, seed: int = 42, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All trials over all feature tables, best first, and the best of each table. ``store``: a folder that keeps finished trials."""
    logs = None
    for name, df in tables.items():
        log = search.random_search(df, trials, seed, name, store)
        logs = log if logs is None else logs.unionByName(log)
    best = logs.withColumn("_n", F.row_number().over(Window.partitionBy("features").orderBy(F.desc("score"), "trial_id"))).where("_n = 1").drop("_n")
    return rank.order_trials(logs), best


def best_assignments(tables: dict[str, DataFrame], best: DataFrame, seed: int = 42) -> DataFrame:
    """(features, key, cluster): the best configuration over all tables, fitted again and ready to be written."""
    top = best.orderBy(F.desc("score"), "features").head()  # a row a table
    return search.refit(tables[top["features"]], top["config"], seed).select(F.lit(top["features"]).alias("features"), "key", "cluster")
