"""Reading and writing the library's tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from ..functions.text import price_dotted, price_strict, stem

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")
PRODUCTS = "brand string, product_name string, join_key string, price_raw string, price_eur long"


def normalise_header(name: str) -> str:
    return re.sub(r"[ .]", "_", name.strip().lower())


def product_columns(names: list[str]) -> tuple[str, str] | None:
    """The first column that starts with ``product`` and the first that contains ``price``; None if one is missing."""
    name = next((c for c in names if c.startswith("product")), None)
    price = next((c for c in names if "price" in c), None)
    return (name, price) if name and price else None


def _bare(path: str) -> str:
    """A path without scheme, authority and last slash."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", path).rstrip("/") or "/"


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Glob patterns, one a parent folder, of those of ``paths`` that are there."""
    by: dict[str, list[str]] = {}
    for path in paths:
        parent, _, name = path.rstrip("/").rpartition("/")
        by.setdefault(parent, []).append(re.sub(r"([\\{}\[\]*?,])", r"\\\1", name))
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for parent, names in by.items():
        pattern = jvm.org.apache.hadoop.fs.Path(f"{parent}/{{{','.join(names)}}}" if len(names) > 1 else f"{parent}/{names[0]}")
        if pattern.getFileSystem(conf).globStatus(pattern):
            out.append(pattern.toString())
    return out


def product_files(spark: SparkSession, folders: dict[str, str]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(brand, file, header) of all CSV files of all brands; headers are read by tasks, a line a file reaches the driver."""
    there = _existing(spark, list(folders.values()))
    if not there:
        return []
    lines = spark.read.text(there).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    by: dict[str, list[str]] = {}
    for brand, path in folders.items():
        by.setdefault(_bare(path), []).append(brand)
    out = []
    for r in first.collect():
        path = unquote(r["file"])
        at = _bare(path)
        while at not in by and "/" in at:
            at = at.rpartition("/")[0]
        header = tuple(next(csv.reader([r["header"].lstrip("\ufeff")]), ()))
        out += [(brand, path, header) for brand in by.get(at, [])]
    return sorted(out)


def read_products(spark: SparkSession, folders: dict[str, str], dotted: frozenset[str] = frozenset()) -> DataFrame:
    """All brands' CSV tables stacked. A brand without folder, CSV or required column is skipped; none left is an error.

    There is one read for each layout of headers, however many brands share it; brands come by a join on the file's path.
    """
    layouts: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for brand, path, header in product_files(spark, folders):
        if product_columns([normalise_header(h) for h in header]):
            layouts.setdefault(header, []).append((brand, path))
    if not layouts:
        raise ValueError("no brand has a product table")
    parts = []
    for header, files in layouts.items():
        names = [normalise_header(h) for h in header]
        name, price = (names.index(c) for c in product_columns(names))
        schema = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])
        raw = spark.read.option("header", True).option("multiLine", True).schema(schema).csv(sorted({path for _, path in files}))
        rows = raw.select(F.col(f"_{name}").alias("product_name"), F.col(f"_{price}").alias("price_raw"), F.col("_metadata.file_path").alias("_file"))
        brands = spark.createDataFrame([(brand, path, brand in dotted) for brand, path in files], "brand string, _path string, _dotted boolean")
        named = rows.join(F.broadcast(brands), F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))) == F.col("_path"))  # a row a file
        clean = F.when(F.col("_dotted"), price_dotted(F.col("price_raw")).cast("long")).otherwise(price_strict(F.col("price_raw")))
        parts.append(named.select("brand", "product_name", stem(F.trim("product_name")).alias("join_key"), "price_raw", clean.alias("price_eur")))
    return reduce(DataFrame.unionByName, parts)


def list_images(spark: SparkSession, brand: str, folder: str, recursive: bool = True) -> DataFrame:
    """(brand, stem, path, suffix) of image files, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.lit(brand).alias("brand"), stem(F.col("path")).alias("stem"), "path", suffix.alias("suffix")).where(F.col("suffix").isin(*IMAGE_SUFFIXES))


#: Pixels in a batch of rows that a task hands on.
PIXEL_ROWS = 1 << 18


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, y, x, r, g, b) of decoded images; grey images repeat their channel, undecodable files are dropped.

    Spark decodes; tasks turn each image's bytes into rows, ``PIXEL_ROWS`` at a time.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, width, channels, data in zip(batch["stem"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int32)  # blue, green, red
                for at in range(0, len(pixels), PIXEL_ROWS):
                    part, place = pixels[at : at + PIXEL_ROWS], np.arange(at, min(at + PIXEL_ROWS, len(pixels)), dtype=np.int32)
                    red, green, blue = (part[:, 0],) * 3 if channels < 3 else (part[:, 2], part[:, 1], part[:, 0])
                    yield pd.DataFrame({"stem": name, "y": place // width, "x": place % width, "r": red, "g": green, "b": blue})

    images = spark.read.format("image").option("dropInvalid", True).load(folder).select(stem(F.col("image.origin")).alias("stem"), "image.width", "image.nChannels", "image.data")
    return images.mapInPandas(unpack, "stem string, y int, x int, r int, g int, b int")


def load_embeddings(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """(key, vec): all numeric columns but ``key`` in file order; without that column the key is the row's number from 0.

    Rows are numbered by file name and position: within each of the pieces that Spark reads, which the counts of the pieces
    before are added to.
    """
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != key]
    vec = F.array(*(F.col(f"`{c}`").cast("double") for c in numeric)).alias("vec")
    if key in df.columns:
        return df.select(F.col(key).cast("string").alias("key"), vec)
    piece = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("piece")
    rows = df.select(piece, F.monotonically_increasing_id().alias("at"), vec)
    ahead = rows.groupBy("piece").count().withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a piece
    place = F.row_number().over(Window.partitionBy("piece").orderBy("at")) - 1
    return rows.withColumn("place", place).join(ahead, "piece").select((F.col("ahead") + F.col("place")).cast("string").alias("key"), "vec")


def load_feature_tables(spark: SparkSession, paths: list[str], key: str = "imagen") -> DataFrame:
    """(features_file, key, vec) of several feature tables; each must have its key column."""
    out = []
    for path in paths:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        if key not in df.columns:
            raise ValueError(f"{path} has no column {key}")
        numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != key]
        out.append(df.select(F.col("_metadata.file_name").alias("features_file"), F.col(key).cast("string").alias("key"), F.array(*(F.col(f"`{c}`").cast("double") for c in numeric)).alias("vec")))
    return reduce(DataFrame.unionByName, out)


def load_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(path, cluster) without noise; both columns are required."""
    df = spark.read.option("header", True).csv(path)
    if missing := {"path", "cluster"} - set(df.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df.select("path", F.col("cluster").try_cast("double").cast("int").alias("cluster")).where("cluster >= 0")


def write_table(df: DataFrame, path: str, by: str | None = None, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer.option("header", True).format(kind).save(path)
