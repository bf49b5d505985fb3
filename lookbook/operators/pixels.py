"""Image features from a pixel table (stem, y, x, r, g, b), aggregated per image with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32


def grey(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> Column:
    return weights[0] * r + weights[1] * g + weights[2] * b


#: Luma weights of the shape mask.
SHAPE_WEIGHTS = (0.2125, 0.7154, 0.0721)
#: Orders of the sums x^p y^q that the moments need.
POWERS = [(p, q) for p in range(4) for q in range(4 - p)]


def colour_histogram(pixels: DataFrame, bins: int = BINS) -> DataFrame:
    """(stem, vec): counts of ``bins`` equal bins on [0, 255] for r, g and b, divided by their length + 1e-8."""
    channel = F.explode(F.array(*(F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate("rgb")))).alias("c")
    place = F.least(F.floor(F.col("c.v") / 255 * bins), F.lit(bins - 1)) + F.col("c.ch") * bins
    counts = pixels.select("stem", channel).select("stem", place.cast("int").alias("bin")).groupBy("stem", "bin").count()
    table = counts.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))  # at most 3 * bins entries
    raw = F.transform(F.sequence(F.lit(0), F.lit(3 * bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("double"))
    return table.withColumn("raw", raw).select("stem", unit_histogram(F.col("raw")).alias("vec"))


def unit_histogram(counts: Column) -> Column:
    """Counts divided by their length + 1e-8."""
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    return F.transform(counts, lambda x: x / size)


def object_box(pixels: DataFrame, dark: Column, pad: int = 5) -> DataFrame:
    """(stem, x0, y0, x1, y1), inclusive: the box of the pixels that are ``dark``, padded and clipped; none: the whole image."""
    inside = lambda c: F.when(dark, F.col(c))
    box = pixels.groupBy("stem").agg(*(f(inside(c)).alias(n) for f, c, n in ((F.min, "x", "a"), (F.min, "y", "b"), (F.max, "x", "c"), (F.max, "y", "d"))), F.max("x").alias("w"), F.max("y").alias("h"))
    zero = F.lit(0)
    return box.select("stem", F.coalesce(F.greatest(F.col("a") - pad, zero), zero).alias("x0"), F.coalesce(F.greatest(F.col("b") - pad, zero), zero).alias("y0"), F.coalesce(F.least(F.col("c") + pad, F.col("w")), F.col("w")).alias("x1"), F.coalesce(F.least(F.col("d") + pad, F.col("h")), F.col("h")).alias("y1"))


def alpha_box(mask: DataFrame, share: float = 0.2) -> DataFrame:
    """The same for a mask (stem, y, x, alpha): alpha > 0, padded by a share of the box."""
    box = object_box(mask, F.col("alpha") > 0, 0)
    ends = mask.groupBy("stem").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    dx, dy = F.floor((F.col("x1") - F.col("x0")) * share), F.floor((F.col("y1") - F.col("y0")) * share)
    zero = F.lit(0)
    return box.join(ends, "stem").select("stem", F.greatest(F.col("x0") - dx, zero).alias("x0"), F.greatest(F.col("y0") - dy, zero).alias("y0"), F.least(F.col("x1") + dx, F.col("w")).alias("x1"), F.least(F.col("y1") + dy, F.col("h")).alias("y1"))


def dark_pixel(limit: int = 235) -> Column:
    return (F.col("r") < limit) | (F.col("g") < limit) | (F.col("b") < limit)


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return pixels.join(boxes, "stem").where(inside).select(pixels.columns)


def whiten(pixels: DataFrame, above: int = 250) -> DataFrame:
    """Pixels whose rounded grey is above the limit become white."""
    light = F.round(grey(F.col("r"), F.col("g"), F.col("b"))) > above
    return pixels.select("stem", "y", "x", *(F.when(light, 255).otherwise(F.col(c)).alias(c) for c in "rgb"))


def merge_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("stem", "y", "x").agg(F.max("alpha").alias("alpha"))


def shape_moments(pixels: DataFrame) -> DataFrame:
    """(stem, area, hu1..hu7, eccentricity, axis_ratio) of the pixels darker than the image's mean grey; no such pixel: nulls.

    Sums of x^p y^q in one aggregation; central, normalised and Hu moments follow in closed form.
    """
    shade = grey(F.col("r"), F.col("g"), F.col("b"), SHAPE_WEIGHTS)
    means = pixels.groupBy("stem").agg(F.avg(shade).alias("mean"))
    px = pixels.join(means, "stem").select("stem", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (shade < F.col("mean")).alias("on"))
    m = px.groupBy("stem").agg(*(F.sum(F.when(F.col("on"), F.pow("x", F.lit(p)) * F.pow("y", F.lit(q)))).alias(f"m{p}{q}") for p, q in POWERS))
    return closed_moments(m, "stem")


def closed_moments(m: DataFrame, *before: Column | str, after: list[Column] = ()) -> DataFrame:
    """(before, area, hu1..hu7, eccentricity, axis_ratio, after) from the sums m00, m01... of x^p y^q."""
    M = {k: F.col(f"m{k[0]}{k[1]}") for k in POWERS}
    m = m.withColumn("cx", M[1, 0] / M[0, 0]).withColumn("cy", M[0, 1] / M[0, 0])
    cx, cy = F.col("cx"), F.col("cy")
    mu = {
        (2, 0): M[2, 0] - cx * M[1, 0], (0, 2): M[0, 2] - cy * M[0, 1], (1, 1): M[1, 1] - cx * M[0, 1],
        (3, 0): M[3, 0] - 3 * cx * M[2, 0] + 2 * cx * cx * M[1, 0], (0, 3): M[0, 3] - 3 * cy * M[0, 2] + 2 * cy * cy * M[0, 1],
        (2, 1): M[2, 1] - 2 * cx * M[1, 1] - cy * M[2, 0] + 2 * cx * cx * M[0, 1], (1, 2): M[1, 2] - 2 * cy * M[1, 1] - cx * M[0, 2] + 2 * cy * cy * M[1, 0],
    }
    for (p, q), e in mu.items():
        m = m.withColumn(f"u{p}{q}", e).withColumn(f"n{p}{q}", e / F.pow(M[0, 0], F.lit((p + q) / 2 + 1)))
    n = {k: F.col(f"n{k[0]}{k[1]}") for k in mu}
    a, b = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    c, d = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    hu = [
        n[2, 0] + n[0, 2],
        (n[2, 0] - n[0, 2]) ** 2 + 4 * n[1, 1] ** 2,
        c**2 + d**2,
        a**2 + b**2,
        c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2),
        (n[2, 0] - n[0, 2]) * (a**2 - b**2) + 4 * n[1, 1] * a * b,
        d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ]
    area = M[0, 0]
    vxx, vyy, vxy = F.col("u20") / area + 1 / 12, F.col("u02") / area + 1 / 12, F.col("u11") / area  # a pixel has an extent of its own
    root = F.sqrt((vxx - vyy) ** 2 + 4 * vxy**2)
    major, minor = (vxx + vyy + root) / 2, (vxx + vyy - root) / 2
    return m.select(*before, area.cast("long").alias("area"), *(h.alias(f"hu{i + 1}") for i, h in enumerate(hu)), F.sqrt(1 - minor / major).alias("eccentricity"), (F.sqrt(major) / (F.sqrt(minor) + 1e-8)).alias("axis_ratio"), *after)


def quick_descriptors(pixels: DataFrame, border: float = 0.08) -> DataFrame:
    """(stem, brightness, mean_saturation, lens_darkness, tortoise_score) after a border cut."""
    size = pixels.groupBy("stem").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    cut_x, cut_y = F.floor(F.col("w") * border), F.floor(F.col("h") * border)
    px = pixels.join(size, "stem").where((F.col("x") >= cut_x) & (F.col("x") < F.col("w") - cut_x) & (F.col("y") >= cut_y) & (F.col("y") < F.col("h") - cut_y))
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    inner = F.col("h") - 2 * cut_y
    band = F.greatest(F.lit(4), F.floor(inner / 6))
    top = cut_y + F.floor((inner - band) / 2)
    central = (F.col("y") >= top) & (F.col("y") < top + band)
    warm = F.greatest((F.col("r") + F.col("g")) / 2 - F.col("b"), F.lit(0)) / 255
    spread = (F.var_pop("r") + F.var_pop("g") + F.var_pop("b")) / 3
    return px.groupBy("stem").agg((F.avg(hi) / 255).alias("brightness"), F.avg(F.when(hi > 0, (hi - lo) / hi).otherwise(0.0)).alias("mean_saturation"), (1 - F.avg(F.when(central, hi)) / 255).alias("lens_darkness"), (F.avg(warm) * spread / 1000).alias("tortoise_score"))


def full_descriptors(pixels: DataFrame, dark: Column | None = None, shapes: DataFrame | None = None) -> DataFrame:
    """quick_descriptors with aspect_ratio of the object box, edge_density and circularity.

    The last two come from ``shapes`` (stem, edge_density, circularity), computed elsewhere; images that it lacks have the
    defaults 0 and 0.4.
    """
    box = object_box(pixels, dark if dark is not None else dark_pixel(), 0)
    aspect = (F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)
    out = quick_descriptors(pixels).join(box.select("stem", aspect.alias("aspect_ratio")), "stem")
    if shapes is not None:
        out = out.join(shapes.select("stem", "edge_density", "circularity"), "stem", "left")
    given = {"edge_density": 0.0, "circularity": 0.4}
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(x)) if shapes is not None else F.lit(x) for c, x in given.items()})
