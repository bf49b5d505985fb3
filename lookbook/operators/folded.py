"""Image features folded from the bytes of decoded images: histogram, box, moments and descriptors without a row a pixel.

An image's bytes are gone through in tiles of rows; a tile leaves sums that add up, so an image of any size takes the memory of
its bytes and one tile. The numbers are those of ``pixels``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from .pixels import BINS, POWERS, SHAPE_WEIGHTS, closed_moments, unit_histogram

#: Pixels of a tile.
TILE = 1 << 18
_SUMS = ["n", "hi", "sat", "band_n", "band_hi", "warm", *(f"{c}{p}" for c in "rgb" for p in (1, 2))]
_MOMENTS = [f"m{p}{q}" for p, q in POWERS]


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, height, width, nChannels, data) of decoded images; undecodable files are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    return images.select(stem(F.col("image.origin")).alias("stem"), "image.height", "image.width", "image.nChannels", "image.data")


def _tiles(data: bytes, height: int, width: int, channels: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, (rows, width, 3) of r, g, b as doubles); grey images repeat their channel."""
    whole, rows = np.frombuffer(data, np.uint8).reshape(height, width, channels), max(1, TILE // width)
    for y in range(0, height, rows):
        part = whole[y : y + rows]
        yield y, (np.repeat(part[:, :, :1], 3, axis=2) if channels < 3 else part[:, :, 2::-1]).astype(float)


def image_sums(data: bytes, height: int, width: int, channels: int, dark: int, bins: int, border: float) -> dict:
    """The sums of one image; the mask of the moments needs the mean grey first."""
    luma = np.array(SHAPE_WEIGHTS)
    grey = sum(float((rgb @ luma).sum()) for _, rgb in _tiles(data, height, width, channels)) / (height * width)
    hist, moments, sums = np.zeros(3 * bins), dict.fromkeys(_MOMENTS, 0.0), dict.fromkeys(_SUMS, 0.0)
    cut_x, cut_y = int(width * border), int(height * border)
    inner = height - 2 * cut_y
    band = max(4, inner // 6)
    top, box = cut_y + (inner - band) // 2, None
    for y0, rgb in _tiles(data, height, width, channels):
        ys, xs = np.arange(y0, y0 + len(rgb), dtype=float), np.arange(width, dtype=float)
        place = np.minimum(np.floor(rgb / 255 * bins), bins - 1).astype(int) + bins * np.arange(3)
        hist += np.bincount(place.reshape(-1), minlength=3 * bins)
        rows, cols = np.nonzero((rgb < dark).any(axis=2))
        if len(rows):
            own = (cols.min(), rows.min() + y0, cols.max(), rows.max() + y0)
            box = own if box is None else (*np.minimum(box[:2], own[:2]), *np.maximum(box[2:], own[2:]))
        on = (rgb @ luma < grey - 1e-9).astype(float)  # an even image has no mask, however its mean is rounded
        for p, q in POWERS:
            moments[f"m{p}{q}"] += float(ys**q @ on @ xs**p)
        keep = (ys >= cut_y) & (ys < height - cut_y)
        part = rgb[keep][:, cut_x : width - cut_x]
        hi, lo, central = part.max(axis=2), part.min(axis=2), (ys[keep] >= top) & (ys[keep] < top + band)
        found = {"n": hi.size, "hi": hi.sum(), "sat": np.where(hi > 0, (hi - lo) / np.where(hi > 0, hi, 1), 0).sum(), "band_n": hi[central].size, "band_hi": hi[central].sum(), "warm": np.maximum((part[:, :, 0] + part[:, :, 1]) / 2 - part[:, :, 2], 0).sum() / 255}
        found |= {f"{c}{p}": (part[:, :, i] ** p).sum() for i, c in enumerate("rgb") for p in (1, 2)}
        for k, v in found.items():
            sums[k] += float(v)
    a, b, c, d = (0, 0, width - 1, height - 1) if box is None else map(int, box)
    return {"hist": hist, "x0": a, "y0": b, "x1": c, "y1": d, "found": box is not None, **moments, **sums}


def image_features(images: DataFrame, dark: int = 235, pad: int = 5, bins: int = BINS, border: float = 0.08) -> DataFrame:
    """(stem, vec, x0, y0, x1, y1, area, hu1..hu7, eccentricity, axis_ratio, brightness, mean_saturation, lens_darkness, tortoise_score, aspect_ratio).

    ``vec`` is ``colour_histogram``, the box ``object_box`` of the pixels with a channel under ``dark``, padded by ``pad``, and aspect_ratio that
    of the box without padding; the rest is as in ``shape_moments`` and ``quick_descriptors``. An image without pixels is dropped.
    """
    names = ["hist", "x0", "y0", "x1", "y1", "found", *_MOMENTS, *_SUMS]
    kinds = {"hist": "array<double>", "found": "boolean"} | dict.fromkeys(("x0", "y0", "x1", "y1"), "int")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                if row.height > 0 and row.width > 0:
                    sums = image_sums(row.data, row.height, row.width, row.nChannels, dark, bins, border)
                    yield pd.DataFrame({"stem": [row.stem], "height": [row.height], "width": [row.width]} | {k: [sums[k]] for k in names})

    schema = "stem string, height int, width int, " + ", ".join(f"{k} {kinds.get(k, 'double')}" for k in names)
    raw = images.select("stem", "height", "width", "nChannels", "data").mapInPandas(fold, schema)
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    spread = sum(mean(f"{c}2") - mean(f"{c}1") * mean(f"{c}1") for c in "rgb") / 3
    aspect = (F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)
    grown = [F.when(F.col("found"), F.greatest(F.col(c) - pad, F.lit(0))).otherwise(F.col(c)).alias(c) for c in ("x0", "y0")]
    grown += [F.when(F.col("found"), F.least(F.col(c) + pad, F.col(size) - 1)).otherwise(F.col(c)).alias(c) for c, size in (("x1", "width"), ("y1", "height"))]
    looks = [(mean("hi") / 255).alias("brightness"), mean("sat").alias("mean_saturation"), (1 - F.try_divide(F.col("band_hi"), F.col("band_n")) / 255).alias("lens_darkness"), (mean("warm") * spread / 1000).alias("tortoise_score"), aspect.alias("aspect_ratio")]
    some = raw.withColumns({m: F.when(F.col("m00") > 0, F.col(m)) for m in _MOMENTS})  # no pixel of the mask: nulls
    return closed_moments(some, "stem", unit_histogram(F.col("hist")).alias("vec"), *grown, after=looks)
