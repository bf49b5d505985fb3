"""Features folded from image bytes against the pixel operators."""

import numpy as np
import pytest

from lookbook.operators import folded
from lookbook.operators import pixels as px


def images(spark, grids):
    """Decoded images in Spark's order of bytes: blue, green, red."""
    rows = [(name, *g.shape[:2], 3, bytearray(g[:, :, ::-1].astype(np.uint8).tobytes())) for name, g in grids.items()]
    return spark.createDataFrame(rows, "stem string, height int, width int, nChannels int, data binary")


def test_folded_features_equal_pixel_operators(spark, monkeypatch):
    monkeypatch.setattr(folded, "TILE", 37)
    rng = np.random.default_rng(0)
    grids = {"noise": rng.integers(0, 256, (23, 17, 3)), "white": np.full((12, 9, 3), 255), "bar": np.full((30, 40, 3), 255), "dark": np.zeros((6, 5, 3), int), "one": np.array([[[7, 8, 9]]])}
    grids["bar"][10:14, 5:33] = (200, 30, 60)
    pixels = spark.createDataFrame([(n, y, x, *map(int, p)) for n, g in grids.items() for y, row in enumerate(g) for x, p in enumerate(row)], "stem string, y int, x int, r int, g int, b int")
    got = {r["stem"]: r for r in folded.image_features(images(spark, grids)).collect()}
    assert set(got) == set(grids) and got["white"]["area"] is None
    for found in (px.colour_histogram(pixels), px.object_box(pixels, px.dark_pixel()), px.shape_moments(pixels), px.quick_descriptors(pixels), px.full_descriptors(pixels).select("stem", "aspect_ratio")):
        for r in found.collect():
            for c, want in r.asDict().items():
                if r["stem"] == "white" and "area" in r:  # in the pixel operator the rounding of the mean decides on an even image
                    continue
                have = got[r["stem"]][c]
                assert have == want or np.allclose(np.array(have, float), np.array(want, float), rtol=1e-6, atol=1e-9, equal_nan=True), (r["stem"], c, have, want)


def test_grey_and_very_large_images(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 9, 1))
    one = spark.createDataFrame([("g", 9, 9, 1, bytearray(grey.astype(np.uint8).tobytes()))], "stem string, height int, width int, nChannels int, data binary")
    both = folded.image_features(one.union(images(spark, {"c": np.repeat(grey, 3, axis=2)}))).collect()
    assert both[0]["vec"] == both[1]["vec"] and both[0]["hu1"] == both[1]["hu1"] and both[0]["mean_saturation"] == 0
    large = np.full((4000, 4000, 3), 255, np.uint8)
    large[1000:2000, 500:3500] = 20
    r = folded.image_features(images(spark, {"large": large})).head()
    assert (r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) == (495, 995, 3504, 2004, 3_000_000) and r["aspect_ratio"] == pytest.approx(3.0)
    assert folded.image_features(one.limit(0)).collect() == []
