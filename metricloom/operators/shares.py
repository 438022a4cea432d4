"""Shares of a scope: grand total, kept or removed columns, selection, parent level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.plans import cells as C
from metricloom.plans.model import Dimension, MetricView
from metricloom.plans.query import columns


def pct_of(
    mv: MetricView,
    spark: SparkSession,
    measure,
    dims: Sequence,
    keep: Sequence[str] | None = None,
    remove: Sequence[str] | None = None,
    where=None,
    selected: bool = False,
) -> DataFrame:
    """Measure, the measure over the scope (`scope_total`) and their ratio (`pct`).

    The scope is given by the dimensions it keeps or removes; by default it keeps none. The scope
    ignores `where` unless `selected` is set. Parts of the measure are aggregated once per `dims`
    group, under and without the condition side by side; scope totals are merged from these groups.
    """
    grain = [mv.dim(d) for d in dims]
    names = [d.name for d in grain]
    scope = list(keep or [])
    if remove is not None:
        scope = [n for n in names if n not in remove]
    resolved = mv.measure(measure)
    m = resolved.name
    conds = C.conditions(where)
    if selected or not conds:
        whole = C.build(mv, spark, [resolved], grain, conds)
        inside = whole = whole.settled()
    else:
        inside, whole = both_sides(mv, spark, [resolved], grain, conds)
    if whole.mergeable:
        total = whole.regroup(scope)
    else:
        total = C.build(mv, spark, [resolved], scope, conds if selected else None)
    totals = total.values().withColumnRenamed(m, "scope_total")
    joined = C.join_hot(inside.values(), totals, scope)
    pct = F.try_divide(F.col(f"`{m}`").cast("double"), F.col("scope_total").cast("double"))
    return joined.select(*columns(names), F.col(f"`{m}`"), "scope_total", pct.alias("pct"))


def both_sides(mv, spark, measures, grain, conds) -> tuple[C.Cells, C.Cells]:
    """Cells under the conditions and without them, from one pass over the facts."""
    measures = tuple(measures)
    leaves = C.leaves_of(measures)
    names = tuple(d.name for d in grain)
    rows = C.project(mv, spark, leaves, C.with_filtered_dims(mv, grain, conds))
    met = F.lit(True)
    for cond in conds:
        met = met & C.as_column(cond)
    rows = rows.withColumn("__in", F.coalesce(met, F.lit(False)))
    wide = rows.withColumns(
        {f"__a{len(leaves) + i}": F.when(F.col("__in"), F.col(f"__a{i}")) for i in range(len(leaves))}
    )
    df = wide.groupBy(*columns(names)).agg(*C.part_columns([*leaves, *leaves]), F.max("__in").alias("__hit"))
    whole = C.Cells(df, names, leaves, measures).settled()
    under_condition = {
        name: F.col(f"__{i + len(leaves)}{part}")
        for i in range(len(leaves))
        for part, name in whole.part_names(i).items()
    }
    return replace(whole, df=whole.df.where("__hit").withColumns(under_condition)), whole


def pct_of_total(mv, spark, measure, dims, where=None) -> DataFrame:
    """Share of the grand total; conditions do not reach the total."""
    return pct_of(mv, spark, measure, dims, where=where)


def pct_of_selected(mv, spark, measure, dims, where) -> DataFrame:
    """Share of the total of what the conditions select."""
    return pct_of(mv, spark, measure, dims, where=where, selected=True)


def pct_of_parent(mv, spark, measure, levels: Sequence, where=None) -> DataFrame:
    """Share of the parent level: all levels but the last."""
    names = [mv.dim(x).name for x in levels]
    return pct_of(mv, spark, measure, levels, keep=names[:-1], where=where, selected=True)


def hierarchy_rollup(mv, spark, levels: Sequence, measures: Sequence, where=None) -> DataFrame:
    """Subtotals for every level of a hierarchy (A25); `level` 0 is the grand total.

    The facts are first reduced to cells (with counted values as one more dimension), so that rows
    are multiplied by the number of levels only after that.
    """
    grain = [mv.dim(x) for x in levels]
    names = [d.name for d in grain]
    resolved = tuple(mv.measure(m) for m in measures)
    leaves = C.leaves_of(resolved)
    additive = tuple(leaf for leaf in leaves if leaf.mergeable)
    distinct = leaves[len(additive) :]
    keys = [Dimension(f"__key{i}", leaf.input()) for i, leaf in enumerate(distinct)]
    cells = C.build(mv, spark, resolved, [*grain, *keys], where, leaves=additive)
    depth = F.lit(len(names)) - F.bit_count(F.grouping_id())
    counted = [F.count_distinct(f"__key{i}").alias(f"__{len(additive) + i}v") for i in range(len(distinct))]
    df = cells.df.rollup(*columns(names)).agg(depth.cast("int").alias("level"), *cells.merged(), *counted)
    return C.Cells(df, tuple(names), leaves, resolved).values(keep=["level"])


def operator_sign(op: Column) -> Column:
    """Weight of a unary operator: + 1, - -1, ~ 0, or the number itself."""
    return (
        F.when(op.isNull() | (op == "+"), F.lit(1))
        .when(op == "-", F.lit(-1))
        .when(op == "~", F.lit(0))
        .otherwise(op.try_cast("decimal(9,6)"))
        .cast("decimal(9,6)")
    )


def custom_rollup(mv, spark, measure, member, operators: Mapping[str, str] | DataFrame, dims=(), where=None):
    """Sum of member values weighted by each member's unary operator (A26), column `rollup`.

    `operators` maps members to operators; a frame (member, operator) is joined instead.
    """
    name, m = mv.dim(member).name, mv.measure(measure).name
    values = C.build(mv, spark, [measure], [*dims, member], where).values()
    if isinstance(operators, DataFrame):
        ops = operators.toDF(name, "__op")
    else:
        ops = spark.createDataFrame(sorted(operators.items()), f"`{name}` string, __op string")
    joined = C.join_on(values, ops, [name])
    weighted = F.col(f"`{m}`") * operator_sign(F.col("__op"))
    keys = [mv.dim(d).name for d in dims]
    return joined.groupBy(*columns(keys)).agg(F.sum(weighted).alias("rollup"))
