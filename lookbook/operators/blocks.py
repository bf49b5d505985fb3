"""Feature blocks: standardising, projecting, joining; centroids."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance, weighted_concat
from . import wide
from .keep import keep


#: Doubles sent to every executor at most (some 32 MB), a row counted as ``ROW_CELLS`` besides its vector.
BROADCAST_CELLS, ROW_CELLS = 4_000_000, 16


#: Dimensions up to which a covariance matrix (128 MB) is made on the driver.
WIDE = 4096


def small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """``df``, kept, and marked for broadcast if its counted size is within the bound; beyond it joins shuffle."""
    df = keep(df)
    cells = df.agg(F.sum(F.lit(ROW_CELLS) + (F.lit(1) if width is None else width))).head()[0] or 0
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def standardise(df: DataFrame, vec: str = "vec", group: str | None = None) -> DataFrame:
    """Zero mean and unit population deviation in each dimension; no deviation: 0. With ``group``, within each group."""
    if group is None:
        vectors = df.where(F.col(vec).isNotNull()).select(array_to_vector(vec).alias("_v"))
        found = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select("s.*").head()  # one aggregate over vectors, whatever their width
        mean, n = found["mean"].toArray().tolist(), found["count"]
        std = [(x * (n - 1) / n) ** 0.5 for x in found["variance"].toArray().tolist()] if n > 1 else [0.0] * len(mean)
        shift, size = F.array(*map(F.lit, mean)).cast("array<double>"), F.array(*map(F.lit, std)).cast("array<double>")
        scaled = F.transform(vec, lambda x, i: F.when(F.get(F.col("_std"), i) > 0, (x - F.get(F.col("_mean"), i)) / F.get(F.col("_std"), i)).otherwise(0.0))
        return df.withColumn("_mean", shift).withColumn("_std", size).withColumn(vec, scaled).drop("_mean", "_std")
    vectors = df.where(F.col(vec).isNotNull()).select(group, array_to_vector(vec).alias("_v"))
    found = vectors.groupBy(group).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))  # one mergeable aggregate a group
    n = F.col("s.count")
    table = found.select(F.col(group).alias("_group"), vector_to_array("s.mean").alias("_mean"), F.when(n > 1, F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * (n - 1) / n))).alias("_std"))
    joined = df.join(table, F.col(group) == F.col("_group"))
    scaled = F.transform(vec, lambda x, i: F.when(F.get("_std", i) > 0, (x - F.get("_mean", i)) / F.get("_std", i)).otherwise(0.0))
    return joined.withColumn(vec, scaled).select(df.columns)


def project(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """The first ``n`` principal components of centred vectors; unchanged unless ``n`` is below their width.

    Up to ``WIDE`` dimensions by the covariance matrix; wider vectors by ``wide.components``, which makes no matrix of width x width.
    """
    first = df.select(F.size(vec).alias("d")).head()
    if first is None or n >= first["d"]:
        return df
    if first["d"] > WIDE:
        return wide.project(df, n, vec)
    table = df.withColumn("_v", array_to_vector(vec))
    return PCA(k=n, inputCol="_v", outputCol="_p").fit(table).transform(table).withColumn(vec, vector_to_array("_p")).drop("_v", "_p")


def join_blocks(key: str, *blocks: tuple[DataFrame, float]) -> DataFrame:
    """(key, vec): weighted blocks side by side; keys that a block lacks are dropped."""
    named = [df.select(key, F.col("vec").alias(f"_b{i}")) for i, (df, _) in enumerate(blocks)]
    joined = reduce(lambda a, b: a.join(b, key), named)
    return joined.select(key, weighted_concat(*((F.col(f"_b{i}"), w) for i, (_, w) in enumerate(blocks))).alias("vec"))


def centroids(df: DataFrame, vec: str = "vec", cluster: str = "cluster", group: str | None = None) -> DataFrame:
    """(group, cluster, n, centroid): mean vectors, noise left out."""
    by = [c for c in (group, cluster) if c]
    found = df.where((F.col(cluster) >= 0) & F.col(vec).isNotNull()).select(*by, array_to_vector(vec).alias("_v"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))  # a vector a cluster is shuffled


def nearest_centroid(df: DataFrame, centres: DataFrame, vec: str = "vec", key: str = "key") -> DataFrame:
    """(key, nearest, dist2): the closest centroid by squared euclidean distance, the smallest cluster among equals.

    The centroids, a row a cluster, are gathered into one array that goes along with every point, so no pairs are made.
    Beyond the broadcast bound they are cut into chunks within it, which points meet by a shuffle, salted by point; each
    chunk leaves its best and the best of those stays, a row a key.
    """
    centres = keep(centres)
    cells = centres.agg(F.sum(F.lit(ROW_CELLS) + F.size("centroid"))).head()[0] or 0
    chunks = int(max(1, -(-cells // BROADCAST_CELLS)))
    ranked = F.transform("_all", lambda c: F.struct(squared_distance(F.col(vec), c["centroid"]).alias("d"), c["cluster"].alias("c")))
    gathered = F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_all")
    if chunks == 1:  # no centroids: an empty array, and nearest is null
        table = centres.agg(gathered).withColumn("_chunk", F.lit(0))
        best = df.withColumn("_chunk", F.lit(0)).join(F.broadcast(table), "_chunk").select(key, F.array_min(ranked).alias("_best"))
    else:
        salts = df.sparkSession.sparkContext.defaultParallelism
        table = centres.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(chunks)).cast("int").alias("_chunk")).agg(gathered)
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        best = dealt.join(table.hint("shuffle_hash"), ["_chunk", "_salt"]).groupBy(key).agg(F.min(F.array_min(ranked)).alias("_best"))
    return best.select(key, F.col("_best")["c"].alias("nearest"), F.col("_best")["d"].alias("dist2"))
