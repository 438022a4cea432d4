"""Row numbers for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.settle import settle

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """`df` with row numbers from 0 in the given order (nulls first).

    Rows are range-partitioned and sorted inside their range; the ranges' sizes give their offsets. Rows that agree in all
    of `order` get their numbers in any way, so equal rows are interchangeable. No task sees more than its range, and only
    one row per range takes part in the sum of offsets.
    """
    by = [F.col(f"`{c}`") for c in order]
    made = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__local", F.monotonically_increasing_id()))
    part = F.shiftright("__local", 33)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = made.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    joined = made.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per range
    return joined.withColumn(name, F.col("__offset") + F.col("__local").bitwiseAND(_LOCAL)).drop("__part", "__offset", "__local")
