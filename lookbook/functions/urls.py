"""Image URLs of product pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entries(srcset: Column) -> Column:
    """array<struct<url, descriptor>>, descriptor null if there is none."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("url"), F.nullif(F.regexp_extract(p, r"^\S+\s+(\S+)$", 1), F.lit("")).alias("mark")))


def _largest(entries: Column, weight) -> Column:
    """The URL of the largest weight, the first of equal ones; entries without weight don't count."""
    ranked = F.transform(entries, lambda e, i: F.struct(weight(e["mark"]).alias("w"), (-i).alias("first"), e["url"].alias("url")))
    return F.array_max(F.filter(ranked, lambda r: r["w"].isNotNull()))["url"]


def srcset_best(srcset: Column, rule: str = "width_or_density") -> Column:
    """The best URL of a srcset; null if it has none.

    width_or_density: largest number before w or x, 1 without descriptor, unreadable ones skipped. width: only w counts, else
    0. strict: entries of the form "url number w|x", else the first URL. last: the last entry. third: the third, else last.
    """
    entries = _entries(srcset)
    if rule == "width_or_density":
        return _largest(entries, lambda m: F.when(m.isNull(), F.lit(1.0)).otherwise(F.regexp_extract(m, r"^([0-9.]+)[wx]$", 1).try_cast("double")))
    if rule == "width":
        return _largest(entries, lambda m: F.coalesce(F.regexp_extract(m, r"^([0-9]+)w$", 1).try_cast("double"), F.lit(0.0)))
    if rule == "strict":
        return F.coalesce(_largest(entries, lambda m: F.regexp_extract(m, r"^([0-9]+)[wx]$", 1).try_cast("double")), F.get(entries, 0)["url"])
    if rule == "last":
        return F.get(entries, F.size(entries) - 1)["url"]
    if rule == "third":
        return F.coalesce(F.get(entries, 2)["url"], F.get(entries, F.size(entries) - 1)["url"])
    raise ValueError(f"unknown rule {rule!r}")


def first_source(*candidates: Column) -> Column:
    """The first candidate that is not a placeholder; null unless it is an http URL."""
    usable = [F.when((F.trim(c) != "") & ~F.contains(F.lower(c), F.lit("placeholder")), c) for c in candidates]
    found = F.coalesce(*usable)
    return F.when(found.startswith("http"), found)


def resolve_url(url: Column, host: str) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(host), url)).otherwise(url)


def zoom_code(url: Column) -> Column:
    """What stands between images/zoom/ and the query, without .jpg."""
    return F.nullif(F.replace(F.regexp_extract(url, r"images/zoom/(\S+)\?", 1), F.lit(".jpg"), F.lit("")), F.lit(""))


def serial_code(url: Column, host: str) -> Column:
    """The first run of 14 letters or digits of a URL on ``host``."""
    return F.when(F.contains(url, F.lit(host)), F.nullif(F.regexp_extract(url, "([A-Za-z0-9]{14})", 1), F.lit("")))
