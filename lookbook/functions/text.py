"""Price, name and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_strict(raw: Column) -> Column:
    """Digits only, as a long; anything else is dropped ("1.000 €" is 1000). No digits: null."""
    return F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit("")).try_cast("long")


def price_dotted(raw: Column) -> Column:
    """Digits and dots, as a double ("370.00" is 370, "1.000 €" is 1). Not a number: null."""
    return F.nullif(F.regexp_replace(raw, "[^0-9.]", ""), F.lit("")).try_cast("double")


def stem(name: Column) -> Column:
    """The last part of a path with / or \\ separators, without its last suffix."""
    last = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 15, F.concat(F.substring(name, 1, 12), F.lit("..."))).otherwise(name)


def display_name(name: Column) -> Column:
    """Without a trailing _id, underscores as spaces, title case, shortened."""
    return short_name(F.initcap(F.replace(F.regexp_replace(name, "_id$", ""), F.lit("_"), F.lit(" "))))


def price_text(price: Column) -> Column:
    return F.coalesce(F.concat(F.lit("€"), F.round(price).cast("long").cast("string")), F.lit("N/A"))


def stats_text(low: Column, mean: Column, high: Column) -> Column:
    return F.concat_ws(" / ", price_text(low), price_text(mean), price_text(high))


def cluster_title(cluster: Column, n: Column) -> Column:
    shown = F.concat(F.lit(" (n="), n.cast("string"), F.lit(")"))
    return F.concat(F.when(cluster < 0, "Outliers").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string"))), shown)


#: Fixed words and limits of family names: shapes by aspect ratio from the widest, then by circularity.
SHAPES = ((2.2, "Slim Rectangle (’90s)"), (1.6, "Rectangular"), (1.25, "Soft Rectangle / Oval"))
ROUND, OTHER_SHAPE = (0.7, "Round / Panto"), "Geometric"
MATERIALS, TORTOISE, LENSES = ("Metal", "Acetate"), "Tortoiseshell", ("Blackout Lenses", "Light/Gradient Lenses")


def family_name(aspect: Column, circularity: Column, edges: Column, saturation: Column, tortoise: Column, darkness: Column) -> Column:
    """Shape, material, pattern (if any) and lens words from averaged descriptors, joined with a middle dot."""
    shape = F.when(circularity >= ROUND[0], ROUND[1]).otherwise(OTHER_SHAPE)
    for least, word in reversed(SHAPES):
        shape = F.when(aspect >= least, word).otherwise(shape)
    material = F.when((edges > 0.08) & (saturation < 0.35), MATERIALS[0]).otherwise(MATERIALS[1])
    return F.concat_ws(" · ", shape, material, F.when(tortoise > 0.12, TORTOISE), F.when(darkness > 0.5, LENSES[0]).otherwise(LENSES[1]))
