"""Ranks, top and bottom members, cumulative shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from metricloom.plans import cells as C
from metricloom.plans import settle as S
from metricloom.plans.model import Measure, MetricView
from metricloom.plans.query import columns, run


def rankx(
    mv: MetricView,
    spark: SparkSession,
    measure,
    member,
    within: Sequence = (),
    ties: str = "skip",
    descending: bool = True,
    where=None,
    window_rows: int = S.WINDOW_ROWS,
) -> DataFrame:
    """Rank of members by a measure, within the groups of `within` (R1, R2); column `rank`.

    `ties='skip'` leaves gaps after ties, `ties='dense'` does not. The member values are
    settled once, so that their number is known before the plan for the ranks is chosen.
    """
    m = mv.measure(measure).name
    groups = [mv.dim(d).name for d in within]
    values = S.settle(run(mv, spark, [measure], [*within, member], where))
    return rank_rows(values, m, groups, ties, descending, window_rows)


def rank_rows(
    df: DataFrame, value: str, groups: Sequence[str], ties="skip", descending=True, window_rows=S.WINDOW_ROWS
) -> DataFrame:
    """Add `rank` to a settled frame."""
    v = F.col(f"`{value}`")
    if S.within(df, window_rows):
        order = v.desc_nulls_last() if descending else v.asc_nulls_last()
        fn = F.dense_rank() if ties == "dense" else F.rank()
        return df.withColumn("rank", fn.over(W.partitionBy(*columns(groups)).orderBy(order)).cast("bigint"))
    # One row per distinct value; a value's rank is one more than the rows (values) before it.
    empty_last = v.isNotNull() if descending else v.isNull()
    keyed = df.withColumn("__v", F.struct(empty_last.alias("e"), v.alias("v")))
    steps = keyed.groupBy(*columns(groups), "__v").agg(F.count(F.lit(1)).alias("__n"))
    steps = steps.withColumn("__one", F.lit(1).cast("bigint"))
    runs = S.prefix_sums(steps, list(groups), "__v", {"__rows": "__n", "__values": "__one"}, descending)
    rank = F.col("__values") if ties == "dense" else F.col("__rows") - F.col("__n") + 1
    ranked = runs.select(*columns(groups), "__v", rank.cast("bigint").alias("rank"))
    return C.join_hot(keyed, ranked, [*groups, "__v"]).drop("__v")


# Spark drops its own limit per task in rank windows beyond this number.
RANK_LIMIT = 1000


def topn(mv, spark, measure, member, n, within=(), where=None, descending=True, strict=False) -> DataFrame:
    """Members among the first `n` (R3): all ties at place `n`, or exactly `n` with `strict`.

    The first values of each group are found among its distinct values, so that ties of any number
    are one row; members of these values are kept. With `strict` the members at the last value are
    numbered by name, by range where they are many.
    """
    m, who = mv.measure(measure).name, mv.dim(member).name
    groups = [mv.dim(d).name for d in within]
    values = S.settle(run(mv, spark, [measure], [*within, member], where))
    names = values.columns
    keyed, first = _first_values(values, m, groups, n, descending)
    ranked = C.join_hot(keyed, S.settle(first).drop("__n"), [*groups, "__v"]).where("rank IS NOT NULL")
    if not strict:
        return ranked.select(*columns(names), "rank")
    ranked = S.settle(ranked)
    last = ranked.groupBy(*columns(groups)).agg(F.max("rank").alias("__last"))
    ranked = C.join_on(ranked, last, groups)
    whole, tied = ranked.where("rank < __last"), ranked.where("rank = __last")
    one = tied.select(*columns(groups), F.col(f"`{who}`"), F.lit(1).cast("bigint").alias("__one"))
    placed = S.prefix_sums(one, groups, who, {"__k": "__one"}).drop("__one")
    inside = C.join_on(tied, placed, [*groups, who]).withColumn("rank", F.col("rank") + F.col("__k") - 1)
    inside = inside.where(F.col("rank") <= n).drop("__k")
    # Members of equal value above the last place are numbered by name as well.
    order = W.partitionBy(*columns(groups), F.col("__v")).orderBy(F.col(f"`{who}`"))
    whole = whole.withColumn("rank", F.col("rank") + F.row_number().over(order) - 1)
    return whole.unionByName(inside).select(*columns(names), F.col("rank").cast("bigint").alias("rank"))


def _first_values(values: DataFrame, m: str, groups: Sequence[str], n: int, descending: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their value as a sortable key `__v`, and the values with ranks up to `n`: `__v`, `__n` members, `rank`."""
    v = F.col(f"`{m}`")
    empty_last = v.isNotNull() if descending else v.isNull()
    keyed = values.withColumn("__v", F.struct(empty_last.alias("e"), v.alias("v")))
    steps = keyed.groupBy(*columns(groups), "__v").agg(F.count(F.lit(1)).alias("__n"))
    if n <= RANK_LIMIT:
        by = F.col("__v").desc() if descending else F.col("__v").asc()
        order = W.partitionBy(*columns(groups)).orderBy(by)
        few = steps.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n)
        runs = few.withColumn("__rows", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__k")
    else:
        counted = steps.withColumn("__sum", F.col("__n"))
        runs = S.prefix_sums(counted, list(groups), "__v", {"__rows": "__sum"}, descending)
    ranked = runs.withColumn("rank", F.col("__rows") - F.col("__n") + 1).where(F.col("rank") <= n)
    return keyed, ranked.select(*columns(groups), "__v", "__n", "rank")


def topn_sum(mv, spark, measure, member, n, within=(), where=None, descending=True, strict=False):
    """Sum of the measure over the top members (R3), column `top_sum`: values times members, the
    members themselves are not needed. With `strict` the last value counts as often as places are left."""
    m = mv.measure(measure).name
    groups = [mv.dim(d).name for d in within]
    values = run(mv, spark, [measure], [*within, member], where)
    _, first = _first_values(values, m, groups, n, descending)
    times = F.least(F.col("__n"), F.lit(n) - F.col("rank") + 1) if strict else F.col("__n")
    return first.groupBy(*columns(groups)).agg(F.sum(F.col("__v.v") * times).alias("top_sum"))


def bottomn_sum(mv, spark, measure, member, n, within=(), where=None, strict=False) -> DataFrame:
    """Sum over the members with the lowest measure (R4), column `top_sum`."""
    return topn_sum(mv, spark, measure, member, n, within, where, False, strict)


def cumulative_pct(mv, spark, col: str, where=None) -> DataFrame:
    """Share of rows whose value is at most each value (R5): `value`, `rows`, `cumulative_pct`.

    Rows are counted per value first; the running counts are range-partitioned, so neither a window
    over all rows nor a comparison of rows with each other takes place.
    """
    item = mv.dim(col)
    counts = C.build(mv, spark, [Measure("rows", "COUNT(1)")], [item], where).values()
    counts = counts.where(F.col(f"`{item.name}`").isNotNull())
    runs = S.settle(S.prefix_sums(counts.withColumnRenamed(item.name, "value"), [], "value", {"upto": "rows"}))
    total = runs.agg(F.max("upto").alias("n")).select("n").scalar()
    return runs.select("value", "rows", (F.col("upto").cast("double") / total).alias("cumulative_pct"))


def order_members(df: DataFrame, measure: str, desc: bool = True) -> DataFrame:
    """Rows in the order of a measure."""
    v = F.col(f"`{measure}`")
    return df.orderBy(v.desc_nulls_last() if desc else v.asc_nulls_last())
