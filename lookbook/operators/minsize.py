"""Minimum cluster size, and names of clusters from descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import family_name
from .blocks import centroids, nearest_centroid, small

DESCRIPTORS = ("aspect_ratio", "circularity", "edge_density", "mean_saturation", "tortoise_score", "lens_darkness")


def enforce_min_size(df: DataFrame, min_size: int = 6, merge: bool = False, key: str = "key", vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """``df`` with small clusters as noise, or (``merge``) their points in the nearest big cluster; no big one: all noise."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_n")).where(F.col(cluster).isNotNull())
    big = sizes.where((F.col("_n") >= min_size) & (F.col(cluster) >= 0)).select(F.col(cluster).alias("_big"))
    out = df.join(small(big), F.col(cluster) == F.col("_big"), "left")
    if merge:
        centres = centroids(out.where("_big is not null").select(vec, F.col("_big").alias("cluster")), vec)
        rest = out.where("_big is null").drop("_big")
        moved = rest.join(nearest_centroid(rest, centres, vec, key), key).withColumn("_big", F.col("nearest")).drop("nearest", "dist2")
        out = out.where("_big is not null").unionByName(moved.select(out.columns))
    return out.withColumn(cluster, F.coalesce("_big", F.lit(-1))).drop("_big")


def describe_clusters(descriptors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, mean of each descriptor), noise left out."""
    return descriptors.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in DESCRIPTORS))


def name_clusters(means: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, name); clusters without any descriptor are called by their number."""
    named = family_name(*(F.col(c) for c in DESCRIPTORS))
    known = F.coalesce(*(F.col(c) for c in DESCRIPTORS)).isNotNull()
    return means.select(cluster, F.when(known, named).otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))).alias("name"))
