"""Members of dimensions: two-level aggregates, conditions, lists, cell sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.functions.time import period_start
from metricloom.plans import cells as C
from metricloom.plans import settle as S
from metricloom.plans.model import Dimension, Measure, MetricView
from metricloom.plans.query import columns, run

# Members per part of a long list.
PART = 10_000


def members(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct members."""
    return df.select(*cols).distinct()


def over_members(mv, spark, measure, member, outer, dims=(), where=None) -> DataFrame:
    """Aggregate over members of a member-level measure.

    `outer` is SQL over the column `value`, such as `MAX(value)` or `AVG(value)`; output `result`.
    """
    m = mv.measure(measure).name
    inner = C.build(mv, spark, [measure], [*dims, member], where).values()
    value = inner.withColumn("value", F.col(f"`{m}`"))
    return value.groupBy(*columns(mv.dim(d).name for d in dims)).agg(F.expr(outer).alias("result"))


def count_members_where(mv, spark, measure, member, condition, dims=(), where=None) -> DataFrame:
    """How many members satisfy a condition on their measure, `value > 1000`."""
    return over_members(mv, spark, measure, member, f"COUNT_IF({condition})", dims, where)


def members_where(mv, spark, member, measure, condition, where=None) -> DataFrame:
    """Members whose measure, seen as `value`, satisfies a condition."""
    d, m = mv.dim(member).name, mv.measure(measure).name
    df = C.build(mv, spark, [measure], [member], where).values()
    return df.select(F.col(f"`{d}`"), F.col(f"`{m}`").alias("value")).where(condition)


def query_members_where(mv, spark, measures, dims, member, condition_measure, condition, where=None):
    """A query restricted to the members that satisfy a condition on their measure.

    The cells per member serve both the condition and the result.
    """
    d = mv.dim(member).name
    tested = replace(mv.measure(condition_measure), name="value")
    asked = [mv.measure(m) for m in measures]
    cells = C.build(mv, spark, [*asked, tested], [*dims, member], where).settled()
    chosen = cells.only([tested]).regroup([d]).values().where(condition).select(F.col(f"`{d}`").alias("__member"))
    kept = cells.df.join(chosen, C.same(f"`{d}`", "__member"), "left_semi")
    return replace(cells, df=kept).only(asked).regroup([mv.dim(x).name for x in dims]).values()


def new_members(mv, spark, member, d, period="month", where=None) -> DataFrame:
    """Members whose first date falls into each period (A18), columns `period`, `new_members`.

    The first date is taken over all facts; conditions apply to the period.
    """
    who, day = mv.dim(member), mv.dim(d)
    first = C.build(mv, spark, [Measure("first_date", f"MIN({day.expr})")], [who]).values()
    first = first.where(F.col(f"`{who.name}`").isNotNull())
    df = first.groupBy(period_start(F.col("first_date"), period).alias("period")).agg(
        F.count(F.lit(1)).alias("new_members")
    )
    for cond in C.conditions(where):
        df = df.where(C.as_column(cond))
    return df


def concatenatex(mv, spark, col: str | Dimension, dims=(), sep=", ", where=None, size: int = PART) -> DataFrame:
    """Sorted list of the distinct members as text (A19): dims, `part`, `parts`, `members`.

    Duplicates are removed before the lists are formed. Members are numbered by range-partitioned
    running counts and a group comes in parts of `size` members, which joined by the separator are
    its list; a group of up to `size` members is one part, whatever else the query returns.
    """
    item = mv.dim(col)
    names = [mv.dim(d).name for d in dims]
    rows = _rows(mv, spark, [*dims, item], where).where(F.expr(f"`{item.name}` IS NOT NULL"))
    rows = rows.withColumn(item.name, F.col(f"`{item.name}`").cast("string")).distinct()
    text = F.array_join(F.array_sort(F.collect_list(F.col(f"`{item.name}`"))), sep).alias("members")
    counted = rows.withColumn("__one", F.lit(1).cast("bigint"))
    numbered = S.settle(S.prefix_sums(counted, names, item.name, {"__n": "__one"}))
    part = F.floor((F.col("__n") - 1) / F.lit(size)).cast("int")
    listed = numbered.withColumn("part", part).groupBy(*columns(names), "part").agg(text)
    last = numbered.groupBy(*columns(names)).agg((F.max(part) + 1).alias("parts"))
    return C.join_on(listed, last, names).select(*columns(names), "part", "parts", "members")


def _rows(mv: MetricView, spark: SparkSession, dims: Sequence, where=None) -> DataFrame:
    grain = [mv.dim(d) for d in dims]
    conds = C.conditions(where)
    df = C.project(mv, spark, [], C.with_filtered_dims(mv, grain, conds))
    for cond in conds:
        df = df.where(C.as_column(cond))
    return df.select(*columns(d.name for d in grain))


def cross_members(mv, spark, dims: Sequence, measures: Sequence, where=None) -> DataFrame:
    """Measures over the combinations of several member sets that have facts.

    Empty combinations are not produced: their number is the product of the sets.
    """
    return run(mv, spark, measures, dims, where)
