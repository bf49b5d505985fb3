"""Expressions over long texts and long arrays in one row, in time that grows with their length and no faster.

``substring`` counts from the start of a text and a fold that appends copies what it has, so either, done for each of many
spans, takes quadratic time. Here a text is cut into chunks once, and running values of an array are made by doubling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a chunk.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def chunks(text: Column) -> Column:
    """The text as an array of chunks of ``CHUNK`` code points; a shorter text is not searched."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def between(of: Column, start: Column, end: Column) -> Column:
    """The text of chunks ``of`` from ``start`` to ``end`` (exclusive, code points); "" where they don't rise."""
    a, b = (F.floor(x / CHUNK).cast("int") for x in (start, end))
    part = lambda k, at, n: F.substring(F.coalesce(F.get(of, k), F.lit("")), at, n)
    first, last = part(a, start % CHUNK + 1, F.lit(CHUNK)), part(b, F.lit(1), end % CHUNK)
    far = F.concat(first, F.when(b - a > 1, F.array_join(F.slice(of, a + 2, F.greatest(b - a - 1, F.lit(0))), "")).otherwise(""), last)
    return F.when(start >= end, "").when(a == b, part(a, start % CHUNK + 1, end - start)).otherwise(far)


def running(values: Column, n: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running values of the array: element i is ``op`` over elements 0 to i. ``n``: its size. Each round doubles the reach."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), lambda j: F.pow(F.lit(2), j).cast("int"))

    def further(acc: Column, r: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= r, op(x, F.get(acc, i - r))).otherwise(x))

    return F.aggregate(reach, values, further)


def plus(a: Column, b: Column) -> Column:
    return a + b


def chosen(values: Column, zero: Column, keep: Callable[[Column, Column], Column], state: Callable[[Column, Column], Column], kind: str, block: int = 128) -> Column:
    """The elements that ``keep(state, x)`` takes, in order, where ``state(state, x)`` goes from one to the next; by blocks of the array."""
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(state(acc["state"], x).alias("state"), F.when(keep(acc["state"], x), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    def whole(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block)), lambda i: F.slice(v, i, F.lit(block)))
        return F.flatten(F.aggregate(parts, F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), whole)["out"])

    return let(values, blocks)
