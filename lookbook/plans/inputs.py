"""The driver's tables as the library's tables: parts as products, embeddings as features with clusters, grids as images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import price_strict
from ..functions.vectors import doubles


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, brand, product_name, price_raw): retail prices in the five shapes that shops write."""
    v = F.floor("p_retailprice").cast("long")
    dotted = F.concat(F.floor(v * 10 / 1000).cast("string"), F.lit("."), F.lpad((v * 10 % 1000).cast("string"), 3, "0"), F.lit(" €"))
    shape, text = F.col("p_partkey") % 5, v.cast("string")
    price = F.when(shape == 0, F.concat(text, F.lit(" €"))).when(shape == 1, F.concat(F.lit("€ "), text)).when(shape == 2, F.concat(F.lit("€"), text)).when(shape == 3, dotted).otherwise("N/A")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), price.alias("price_raw"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_products(spark, sf_dir).withColumn("price_eur", price_strict(F.col("price_raw")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vec, cluster)"""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), doubles(F.col("embedding")).alias("vec"), F.col("label").alias("cluster"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, y, x, r, g, b): each embedding as an 8 x 8 image of three shifted channels."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stem"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))

    def shade(shift: int):
        raw = F.floor((F.get("embedding", (F.col("i") + shift) % 64).cast("double") + 0.5) * 255)
        return F.least(F.lit(255), F.greatest(F.lit(0), raw)).cast("int")

    return rows.select("stem", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), shade(0).alias("r"), shade(1).alias("g"), shade(2).alias("b"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, algo, n_clusters, silhouette, ch, db): a scored run for each brand and size, some scores missing."""
    price = F.col("p_retailprice")
    g = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("algo"), F.col("p_size").cast("long").alias("n_clusters")).agg(F.avg(price).alias("m"), F.count("*").alias("c"), F.min(price).alias("lo"))
    none = F.col("algo").endswith("5")
    return g.select(
        F.concat_ws("-", "algo", F.lpad(F.col("n_clusters").cast("string"), 2, "0")).alias("run_id"), "algo", "n_clusters", F.when(~none & (F.col("n_clusters") % 7 != 0), F.round(F.col("m") / 2000, 6)).alias("silhouette"),
        F.when(~none & (F.col("n_clusters") % 3 != 0), F.col("c").cast("double")).alias("ch"), F.when(~none, F.round(F.col("lo") / 1000, 6)).alias("db"),
    )


def srcsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, srcset) with widths, densities, ties, bad and missing descriptors."""
    u = F.col("url")
    entry = lambda *parts: F.concat_ws(", ", *(F.concat(u, F.lit(p)) for p in parts))
    shapes = [("?w=320 320w", "?w=640 640w", "?w=480 480w"), ("?a 1x", "?b 2x"), ("",), ("?a bad", "?b 2x"), ("?a 300w", "?b 300w"), ("?a 300w", "?b 2x", "?c 100w", "?d")]
    text = entry(*shapes[-1])
    for i, s in enumerate(shapes[:-1]):
        text = F.when(F.col("page_id") % 6 == i, entry(*s)).otherwise(text)
    return read(spark, sf_dir, "pages").select("page_id", "url", text.alias("srcset"))


def small_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points`` with every tenth point in one of many small clusters."""
    return points(spark, sf_dir).withColumn("cluster", F.when(F.col("key") % 10 == 0, 100 + F.floor(F.col("key") / 10) % 40).otherwise(F.col("cluster")).cast("int"))
