"""Row numbers and running sums of groups, without sorting a whole group in one task.

The order column is cut into ranges at its quantiles; rows are numbered within a group's range, and the counts of the ranges
before, a row for each group and range, are added up. A group with a third of all rows is spread over as many tasks as there
are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most: their bounds, a number each, are all that reaches the driver.
RANGES = 256


def running_sum(df: DataFrame, group: list[str], order: str, amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of the same group that come before in ``order``.

    ``order`` is numeric; rows that tie in it come in any order and in one range. Null groups are a group; null orders come first.
    """
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000)).head()[0] if n > 1 else []
    cells = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds or [])))).cast("array<double>"), lambda b: b < at))
    rows = df.withColumn("_cell", F.struct(*(F.col(c) for c in group), F.coalesce(cells, F.lit(-1)).alias("_range")))  # structs compare null fields as equal
    whole = F.struct(*(F.col("_cell")[c] for c in group))
    before = Window.partitionBy(whole).orderBy(F.col("_cell")["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_cell").agg(F.sum(amount).alias("_in")).select("_cell", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_ahead"))
    within = F.sum(amount).over(Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(within, F.lit(0))).join(ahead, "_cell").withColumn(name, F.col(name) + F.col("_ahead")).drop("_cell", "_ahead")


def numbered(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... within each group in ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1)), group, order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")
