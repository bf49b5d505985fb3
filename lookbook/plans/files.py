"""Driver tables written as the files that the sources read: product CSVs of several layouts, images, feature tables."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names; a local one only in local mode."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='lookbook-')}/files-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def product_folders(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Raw products dealt over five brands, each in a CSV layout of its own; one brand's table has no price and one has no folder."""
    raw, to = inputs.raw_products(spark, sf_dir), scratch(spark)
    part = lambda i: raw.where(F.col("key") % 5 == i)
    file = F.concat(F.lit("img/x."), F.col("key").cast("string"), F.lit(".jpg"))
    shapes = {
        "A": part(0).select(file.alias("Product Name"), F.col("price_raw").alias("Price")), "B": part(1).select(file.alias("Product_ID"), F.col("price_raw").alias("Price")),
        "C": part(2).select(file.alias("Product Name"), F.col("price_raw").alias("Price"), F.lit("http://x").alias("Image URL")), "D": part(3).select(F.lit("n").alias("id"), file.alias(" Product.Name "), F.col("price_raw").alias("Sale Price")),
        "E": part(4).select(file.alias("Product Name"), F.lit(1).alias("Stock")),
    }
    return {brand: _csv(df, f"{to}/{brand}") for brand, df in shapes.items()} | {"F": f"{to}/none"}


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width, 3)."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + line.tobytes() for line in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """The images of ``inputs.pixels`` as PNG files, written by tasks, each file under its own name."""
    to = scratch(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = fs.FileSystem.from_uri(to if ":" in to else f"file://{to}")
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, values in zip(batch["stem"], batch["values"], strict=True):
                with system.open_output_stream(f"{inner}/{name}.png", compression=None) as file:
                    file.write(png(np.array(values).reshape(8, 8, 3)))
            yield pd.DataFrame({"n": [len(batch)]})

    shades = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))), lambda p: F.array(p["r"], p["g"], p["b"])))  # 64 pixels
    inputs.pixels(spark, sf_dir).groupBy("stem").agg(shades.alias("values")).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return to


def embeddings_csv(spark: SparkSession, sf_dir: str, key: str | None, name: str = "a") -> str:
    """(key, f0, f1...) without the key column if it has no name; rows by key, in one file a partition."""
    points = inputs.points(spark, sf_dir)
    columns = [F.get("vec", F.lit(i)).alias(f"f{i}") for i in range(64)]
    rows = points.repartitionByRange(4, "key").sortWithinPartitions("key")
    return _csv(rows.select(*([F.col("key").cast("string").alias(key)] if key else []), *columns), f"{scratch(spark)}/{name}")


def assignments_csv(spark: SparkSession, sf_dir: str) -> str:
    cluster = F.when(F.col("key") % 9 == 0, "-1").when(F.col("key") % 11 == 0, "none").otherwise(F.concat(F.col("cluster").cast("string"), F.lit(".0")))
    return _csv(inputs.points(spark, sf_dir).select(F.col("key").cast("string").alias("path"), cluster.alias("cluster")), f"{scratch(spark)}/a")
