"""Ranking of clusters and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small


def rank_clusters(stats: DataFrame, value: str, partner: str | None = None) -> DataFrame:
    """(group, run, cluster, rank, value, partner): 0 for the largest value; the smaller cluster first among equals."""
    w = Window.partitionBy("group", "run").orderBy(F.desc(value), "cluster")  # a row a cluster
    other = F.col(partner) if partner else F.lit(None).cast("int")
    return stats.select("group", "run", "cluster", (F.row_number().over(w) - 1).alias("rank"), F.col(value).alias("value"), other.alias("partner"))


def relabel(assignments: DataFrame, ranks: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters renamed by rank; noise stays -1. ``ranks`` has a row a cluster."""
    table = ranks.select(F.col("cluster").alias("_old"), F.col("rank").alias("_new"))
    return assignments.join(small(table), F.col(cluster) == F.col("_old"), "left").withColumn(cluster, F.coalesce("_new", F.lit(-1))).drop("_old", "_new")


def best_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best row of each group: highest silhouette, else CH, else lowest DB, else most clusters; then the first run_id."""
    none = F.col("silhouette").isNull() & F.col("ch").isNull() & F.col("db").isNull()
    order = [F.desc_nulls_last("silhouette"), F.desc_nulls_last("ch"), F.asc_nulls_last("db"), F.desc_nulls_last(F.when(none, F.col("n_clusters"))), F.asc("run_id")]
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return runs.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def tolerant_k(scores: DataFrame, by: list[str], tolerance: float = 0.95, floor: int = 4, n: str | None = None) -> DataFrame:
    """(by, best_k): the first k > ``floor`` in score order within the tolerance of a positive best, else the best; >= floor.

    Groups without a score get null; with ``n`` (a column of group sizes) k is at most n.
    """
    kept = scores.where("score is not null")
    w = Window.partitionBy(*by)
    ranked = kept.withColumn("best", F.max("score").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "k")))
    near = F.when((F.col("k") > floor) & (F.col("best") > 0) & (F.col("score") > tolerance * F.col("best")), F.col("place"))
    pick = ranked.withColumn("near", F.min(near).over(w)).where("place = coalesce(near, 1)")
    best = F.greatest(F.col("k"), F.lit(floor))
    best = F.least(best, F.col(n)) if n else best
    return scores.select(*by).distinct().join(pick.select(*by, best.cast("long").alias("best_k")), by, "left")


def strict_k(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, best_k, score): the highest score, the smallest k among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "k")
    ranked = scores.where("score is not null").withColumn("place", F.row_number().over(w))
    return ranked.where("place = 1").select(*by, F.col("k").cast("long").alias("best_k"), "score")


def order_trials(trials: DataFrame, score: str = "score") -> DataFrame:
    return trials.orderBy(F.desc_nulls_last(score), "trial_id")
