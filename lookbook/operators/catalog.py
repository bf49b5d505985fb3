"""Joins, price statistics, ids and ranks of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, running_sum


def priced(products: DataFrame) -> DataFrame:
    return products.na.drop(subset=["price_eur"])


def in_range(products: DataFrame, low: float, high: float, brands: list[str] | None = None) -> DataFrame:
    kept = products.where(F.col("price_eur").between(low, high))
    return kept.where(F.col("brand").isin(*brands)) if brands else kept


def with_features(products: DataFrame, features: DataFrame, key: str = "join_key") -> DataFrame:
    return products.join(features, key, "inner")


def with_files(prices: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Price rows whose file exists."""
    return prices.join(files, keys, "left_semi")


def assigned_prices(assignments: DataFrame, prices: DataFrame, key: str, check: bool = False) -> DataFrame:
    joined = assignments.join(prices, key, "inner")
    if check and joined.isEmpty():
        raise ValueError("no assignment has a price")
    return joined


def pair_by_position(images: DataFrame, prices: DataFrame, group: str, order: str) -> DataFrame:
    """The n-th image of a group with its n-th price; a missing price is N/A."""
    a, b = (numbered(df, [group], order, "idx").drop(order) for df in (images, prices))
    return a.join(b, [group, "idx"], "left").withColumn("price", F.coalesce("price", F.lit("N/A")))


def one_per_key(df: DataFrame, key: list[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by load order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("row")
    return df.groupBy(*key).agg(row).select(*key, "row.*").select(df.columns)


def capped_first(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Distinct keys, first seen, in order, ``limit`` of them at most."""
    return one_per_key(df, [key], order, last=False).orderBy(order).limit(limit)


def sequential_ids(df: DataFrame, group: str, order: str, valid: str | None = None, count_invalid: bool = False) -> DataFrame:
    """product_id = Group_1..n by position. Rows that aren't ``valid`` are dropped; with ``count_invalid`` they use up a number."""
    rows = df.where(valid) if valid and not count_invalid else df
    out = numbered(rows, [group], order, "_n")
    out = out.withColumn("product_id", F.concat_ws("_", F.col(group), F.col("_n").cast("string"))).drop("_n")
    return out.where(valid) if valid else out


def collision_free(df: DataFrame, name: str, order: str) -> DataFrame:
    """``unique_name``: from its second appearance on, a name gets _1, _2... before its suffix, whichever is free.

    The first rows of all names keep theirs; later ones take, in order, the numbers that no name of the table has already.
    """
    rows = numbered(df, [name], order, "_n")
    taken = F.regexp_extract(name, r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$", 2)
    of = F.concat(F.regexp_extract(name, r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$", 3))
    held = rows.where("_n = 1").where(taken != "").select(of.alias("_name"), taken.cast("long").alias("_number"))
    again = rows.where("_n > 1").select(F.col(name).alias("_name"), (F.col("_n") - 1).alias("_n"))
    held = held.join(again.where("_n = 1").select("_name"), "_name", "left_semi")  # names that need numbers
    # the n-th free number is n and as many more as there are taken numbers t, the i-th from 0, with t - i <= n
    steps = numbered(held, ["_name"], "_number", "_i").select("_name", (2 * (F.col("_number") - F.col("_i") + 1)).alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast("long").alias("_n"))
    free = running_sum(steps.union(again.select("_name", 2 * F.col("_n") + 1, F.lit(0), "_n")), ["_name"], "_at", "_one", "_more").where("_n is not null")
    free = free.select("_name", (F.col("_n") + 1).alias("_n"), (F.col("_n") + F.col("_more")).alias("_number"))
    body, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    out = rows.join(free.withColumnRenamed("_name", name), [name, "_n"], "left")
    new = F.when(F.col("_number").isNotNull(), F.concat(body, F.lit("_"), F.col("_number").cast("string"), suffix)).otherwise(F.col(name))
    return out.withColumn("unique_name", new).select(*df.columns, "unique_name")


def first_per_cluster(df: DataFrame, m: int, order: str, cluster: str = "cluster") -> DataFrame:
    """The first ``m`` rows of each cluster (0: all) with the cluster's real size.

    With ``m``, tasks keep their own first ``m`` rows of a cluster before anything is shuffled.
    """
    if m:
        first = df.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(order))).where(F.col("place") <= m)
    else:
        first = numbered(df, [cluster], order, "place").withColumn("place", F.col("place").cast("int"))
    sizes = df.groupBy(F.col(cluster).alias("_cluster")).agg(F.count("*").alias("size"))
    return first.join(sizes, F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")


def price_stats(df: DataFrame, by: list[str], price: str = "price_eur") -> DataFrame:
    p = F.col(price)
    return df.groupBy(*by).agg(F.count(p).alias("n"), F.round(F.avg(p), 2).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


def price_premium(df: DataFrame, by: str = "cluster", brand: str = "brand", price: str = "price_eur") -> DataFrame:
    """price_stats per brand and cluster with premium = cluster mean / brand mean."""
    sums = df.groupBy(brand, by).agg(F.count(price).alias("n"), F.sum(price).alias("total"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    w = Window.partitionBy(brand)
    mean = F.try_divide("total", "n")
    whole = F.try_divide(F.sum("total").over(w), F.sum("n").over(w))
    return sums.select(brand, by, "n", F.round(mean, 2).alias("mean_price"), "min_price", "max_price", F.round(F.try_divide(mean, whole), 4).alias("premium"))


def price_rollup(df: DataFrame, brand: str = "brand", cluster: str = "cluster", price: str = "price_eur") -> DataFrame:
    return df.rollup(brand, cluster).agg(F.count(price).alias("n"), F.round(F.avg(price), 2).alias("mean_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))


def brand_profile(products: DataFrame, low: float, high: float) -> DataFrame:
    p = F.col("price_eur")
    return products.groupBy("brand").agg(F.count("*").alias("n_rows"), F.count(p).alias("n_priced"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.count_if(p.between(low, high)).alias("n_in_range"))


def cluster_sizes(assignments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, share) with the counts over all clusters: n_clusters without noise, noise rows and their fraction."""
    w = Window.partitionBy(F.lit(1))  # a row a cluster
    sizes = assignments.groupBy(cluster).agg(F.count("*").alias("size"))
    noise = F.coalesce(F.sum(F.when(F.col(cluster) < 0, F.col("size"))).over(w), F.lit(0))
    total = F.sum("size").over(w)
    return sizes.select(cluster, "size", (F.col("size") / total).alias("share"), F.count_if(F.col(cluster) >= 0).over(w).alias("n_clusters"), noise.alias("n_noise"), (noise / total).alias("noise_frac"))
