"""Scores of a clustering: Calinski-Harabasz, Davies-Bouldin, the bundle and the composite score.

All are made for any number of label sets at once: points are read once for the distances and once for the centroids,
whatever the number of sets.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance, dot, squared_distance
from .blocks import centroids, small
from .distance import cluster_sums, silhouette, with_labels
from .keep import keep


def _spread(flat: DataFrame) -> DataFrame:
    """(run, cluster, n, centroid, within, mean_dist): sums of squares and mean distance to the centroid."""
    by = ["run", "cluster"]
    centres = small(centroids(flat, "vec", "cluster", "run"), F.size("centroid"))  # a row a cluster
    d2 = squared_distance(F.col("vec"), F.col("centroid"))
    sums = flat.where("cluster >= 0").join(centres, by).groupBy(by).agg(F.sum(d2).alias("within"), F.avg(F.sqrt(d2)).alias("mean_dist"))
    return keep(centres.join(sums, by))


def _ch(spread: DataFrame) -> DataFrame:
    """(run, ch): null unless 2 <= clusters <= points - 1."""
    cells = spread.select("run", "n", F.posexplode("centroid").alias("i", "x")).groupBy("run", "i").agg(F.sum(F.col("n") * F.col("x")).alias("s1"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("s2"), F.sum("n").alias("total"))
    between = cells.groupBy("run").agg(F.sum(F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")).alias("between"))
    within = spread.groupBy("run").agg(F.sum("within").alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    ch = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return between.join(within, "run").select("run", F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), F.coalesce(ch, F.lit(1.0))).alias("ch"))


def _db(spread: DataFrame) -> DataFrame:
    """(run, db): missing with fewer than two clusters. The pairs are of a run's clusters, not of points."""
    a, b = (spread.select("run", F.col("cluster").alias(f"c{i}"), F.col("centroid").alias(f"v{i}"), F.col("mean_dist").alias(f"m{i}")) for i in (1, 2))
    ratio = F.coalesce(F.try_divide(F.col("m1") + F.col("m2"), distance(F.col("v1"), F.col("v2"))), F.lit(0.0))
    worst = a.join(b, "run").where("c1 <> c2").groupBy("run", "c1").agg(F.max(ratio).alias("r"))
    return worst.groupBy("run").agg(F.avg("r").alias("db"))


def _flat(df: DataFrame, vec: str, labels: Column) -> DataFrame:
    return df.select(F.col(vec).alias("vec"), F.posexplode(labels).alias("run", "cluster"))


def calinski_harabasz(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """One row (ch): null unless 2 <= clusters <= points - 1; noise left out."""
    return _ch(_spread(_flat(df, vec, F.array(cluster)))).agg(F.max("ch").alias("ch"))


def davies_bouldin(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """One row (db): null with fewer than two clusters; noise left out."""
    return _db(_spread(_flat(df, vec, F.array(cluster)))).agg(F.max("db").alias("db"))


def score_sets(df: DataFrame, vec: str = "vec", labels: str = "labels", key: str = "key") -> DataFrame:
    """(run, n_clusters, noise_frac, silhouette, ch, db): a row a label set of the array ``labels``, noise left out of the scores."""
    points = keep(df.select(F.col(key).alias("key"), F.col(vec).alias("vec"), F.col(labels).alias("labels")))
    flat = _flat(points, "vec", F.col("labels"))
    counts = flat.groupBy("run").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.try_divide(F.count_if(F.col("cluster") < 0), F.count("*")).alias("noise_frac"))
    spread, sil = _spread(flat), silhouette(cluster_sums(points)).select("run", "silhouette")
    return counts.join(sil, "run", "left").join(_ch(spread), "run", "left").join(_db(spread), "run", "left")


def score_bundle(df: DataFrame, vec: str = "vec", cluster: str = "cluster", key: str = "key") -> DataFrame:
    """(n_clusters, noise_frac, silhouette, ch, db) of one clustering: a row, or none for an empty table."""
    return score_sets(with_labels(df.select(F.col(key).alias("key"), F.col(vec).alias("vec"), F.col(cluster).alias("cluster")))).drop("run")


def squared_silhouette(df: DataFrame, vec: str = "vec", labels: str = "labels", group: str | None = None) -> DataFrame:
    """(group, run, silhouette, n_points, n_clusters) over squared euclidean distances, in time linear in the points, for all label sets.

    The squared distances of a point x to a cluster of n points with vector sum s and square sum q add up to n x.x - 2 x.s + q, so one
    aggregate over the points and one pass with a row a cluster give the exact mean. Numbers differ from ``silhouette``, which takes
    the distances themselves. Noise takes no part; points alone in their cluster score 0; null with fewer than two clusters.
    """
    name = F.col(group).cast("string") if group else F.lit("")
    flat = keep(df.select(name.alias("group"), F.col(vec).alias("vec"), F.posexplode(labels).alias("run", "cluster")).where("cluster >= 0"))
    sums = flat.groupBy("group", "run", "cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("s"), F.sum(dot(F.col("vec"), F.col("vec"))).alias("q"), F.count("*").alias("n"))
    table = small(sums.groupBy("group", "run").agg(F.collect_list(F.struct("cluster", "n", "s", "q")).alias("all")), F.aggregate("all", F.lit(0).cast("long"), lambda a, c: a + F.size(c["s"])))
    square = dot(F.col("vec"), F.col("vec"))
    met = flat.join(table.withColumnsRenamed({"group": "_g", "run": "_r"}), F.col("group").eqNullSafe(F.col("_g")) & (F.col("run") == F.col("_r")))
    total = F.transform("all", lambda c: F.struct(c["cluster"].alias("cluster"), c["n"].alias("n"), F.greatest(c["n"] * F.col("square") - 2 * dot(F.col("vec"), c["s"]) + c["q"], F.lit(0.0)).alias("d")))
    met = met.withColumn("square", square).select("group", "run", "cluster", total.alias("to"))
    own = F.get(F.filter("to", lambda c: c["cluster"] == F.col("cluster")), 0)
    a = F.when(own["n"] > 1, own["d"] / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("to", lambda c: c["cluster"] != F.col("cluster")), lambda c: c["d"] / c["n"]))
    each = met.select("group", "run", "cluster", a.alias("a"), b.alias("b")).withColumn("top", F.greatest("a", "b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (F.col("top") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.col("top"))
    out = each.withColumn("s", s).groupBy("group", "run").agg(F.avg("s").alias("silhouette"), F.count("*").alias("n_points"), F.count_distinct("cluster").alias("n_clusters"))
    return out.withColumn("silhouette", F.when(F.col("n_clusters") >= 2, F.col("silhouette")))


def composite(sil: Column, ch: Column, db: Column) -> Column:
    """silhouette + 0.002 CH + 1 / (1 + DB); -1e9 where the silhouette is missing."""
    return F.when(sil.isNull(), F.lit(-1e9)).otherwise(sil + 0.002 * F.coalesce(ch, F.lit(0.0)) + F.coalesce(1 / (1 + db), F.lit(0.0)))
