"""Time intelligence (T2-T12, T16) and calendars that show every date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from metricloom.functions.time import MONTHS, interval, period_start, shift
from metricloom.plans import cells as C
from metricloom.plans.model import Dimension, Measure, MetricView, Window, mentions
from metricloom.plans.query import columns, frame_text, run, split_conditions
from metricloom.plans.settle import settle


def _with_window(mv: MetricView, measure: str | Measure, *windows: Window) -> Measure:
    return replace(mv.measure(measure), window=tuple(windows))


def windowed_measure(mv, spark, measure, d, dims=(), where=None, ranges="cumulative", include_anchor=False):
    """A measure under one window range, by `dims` and the order dimension `d`."""
    m = _with_window(mv, measure, Window(mv.dim(d).name, ranges, include_anchor=include_anchor))
    grain = list(dims) if mv.dim(d).name in [mv.dim(x).name for x in dims] else [*dims, d]
    return run(mv, spark, [m], grain, where)


def running_total(mv, spark, measure, d, dims=(), where=None) -> DataFrame:
    """From the first member up to the current one."""
    return windowed_measure(mv, spark, measure, d, dims, where, "cumulative")


def trailing(mv, spark, measure, d, n, unit, dims=(), where=None, include_anchor=False) -> DataFrame:
    """The N units before the anchor; with `include_anchor` the N units that end with it (T4)."""
    return windowed_measure(mv, spark, measure, d, dims, where, f"trailing {n} {unit}", include_anchor)


def leading(mv, spark, measure, d, n, unit, dims=(), where=None, include_anchor=False) -> DataFrame:
    return windowed_measure(mv, spark, measure, d, dims, where, f"leading {n} {unit}", include_anchor)


def windowed_distinct(mv, spark, col, d, ranges, dims=(), where=None, include_anchor=False) -> DataFrame:
    """Distinct count of a column in a window."""
    m = Measure(f"distinct_{col}".replace(".", "_"), f"COUNT(DISTINCT {col})")
    return windowed_measure(mv, spark, m, d, dims, where, ranges, include_anchor)


def _split(mv: MetricView, d, where) -> tuple[list, list]:
    """Conditions before the window, and those on `d` for after it."""
    order = mv.dim(d)
    early, late = split_conditions(mv, C.conditions(where), order)
    for cond in late:
        others = [x.name for x in mv.dimensions if x != order and mentions(C.condition_text(cond), x.name)]
        if others:
            raise ValueError(f"state the condition on {order.name} itself, not on {others}")
    return early, late


def _early(mv: MetricView, spark: SparkSession, measures, dims, d, unit, where=None) -> C.Cells:
    """Cells at (dims, period of d); the period column keeps the name of `d`."""
    day = mv.dim(d)
    grain = Dimension(day.name, _period_sql(day.expr, unit))
    return C.build(mv, spark, measures, [*dims, grain], where)


def _period_sql(expr: str, unit: str) -> str:
    if unit == "day":
        return f"CAST({expr} AS DATE)"
    return f"CAST(date_trunc('{unit}', {expr}) AS DATE)"


def period_to_date(mv, spark, measure, d, period="year", dims=(), where=None, grain="day") -> DataFrame:
    """Running value since the start of the year, quarter or month (T3), per `grain` step."""
    early, late = _split(mv, d, where)
    cells = _early(mv, spark, [measure], dims, d, grain, early)
    order = mv.dim(d).name
    start = "__start"
    cells = replace(cells, df=cells.df.withColumn(start, period_start(F.col(f"`{order}`"), period)))
    keys = [x for x in cells.dims if x != order]
    frame = frame_text([*keys, start], order, "UNBOUNDED PRECEDING AND CURRENT ROW")
    return _late(cells.over(frame).values(), late)


def rolling(mv, spark, measure, d, n, period="month", agg="avg", dims=(), where=None) -> DataFrame:
    """Aggregate of the period values over the last N periods, the current one included (T5).

    Periods without facts count as empty cells, not as zeros. Output column `rolling`.
    """
    early, late = _split(mv, d, where)
    values = _early(mv, spark, [measure], dims, d, period, early).values()
    order, m = mv.dim(d).name, mv.measure(measure).name
    keys = [c for c in values.columns if c not in (order, m)]
    frame = frame_text(keys, order, f"{interval(n - 1, period)} PRECEDING AND CURRENT ROW")
    if agg == "avg":
        value = f"try_divide(CAST(sum(`{m}`) OVER ({frame}) AS DOUBLE), count(`{m}`) OVER ({frame}))"
    else:
        value = f"{agg}(`{m}`) OVER ({frame})"
    return _late(values.withColumn("rolling", F.expr(value)), late)


def shifted(values: DataFrame, order: str, n: int, unit: str, measures: Sequence[str], suffix: str) -> DataFrame:
    """Each row with the values found `n` units away (earlier when negative) on the order column.

    Every row is sent to its own date and to the dates that look it up, and both meet in one
    aggregation; the values are computed once and nothing is joined. A month end may be looked up
    from up to four dates (28 February from 28 to 31 March).
    """
    keys = [c for c in values.columns if c not in (*measures, order)]
    day = F.col(f"`{order}`")
    back = shift(day, -n, unit)
    near = F.sequence(back, F.date_add(back, 3 if unit in MONTHS else 0))
    lookers = F.coalesce(F.filter(near, lambda a: shift(a, n, unit) == day), F.array().cast("array<date>"))
    types = dict(values.dtypes)
    now, then = ([f"__{side}{i}" for i in range(len(measures))] for side in ("now", "then"))

    def sent(at: Column, own: bool) -> Column:
        """A row for a date, with the values in the place of its own or of the looked-up ones."""
        given = [F.col(f"`{m}`") for m in measures]
        none = [F.lit(None).cast(types[m]) for m in measures]
        first, second = (given, none) if own else (none, given)
        named = [c.alias(n) for c, n in zip([*first, *second], [*now, *then])]
        return F.struct(at.alias("__day"), F.lit(own).alias("__own"), *named)

    both = values.select(
        *columns(keys), F.inline(F.concat(F.array(sent(day, True)), F.transform(lookers, lambda a: sent(a, False))))
    )
    met = both.groupBy(*columns(keys), F.col("__day").alias(order)).agg(
        F.max("__own").alias("__own"), *[F.max(c).alias(c) for c in (*now, *then)]
    )
    back_to = dict(zip(measures, now))
    return met.where("__own").select(
        *[F.col(f"`{back_to.get(c, c)}`").alias(c) for c in values.columns],
        *[F.col(t).alias(f"{m}{suffix}") for m, t in zip(measures, then)],
    )


def date_shift(mv, spark, measure, d, n, unit, grain=None, dims=(), where=None, suffix="_prior") -> DataFrame:
    """Value beside the value `n` units away (T8). The grain defaults to the shifted unit."""
    early, late = _split(mv, d, where)
    values = _early(mv, spark, [measure], dims, d, grain or unit, early).values()
    m = mv.measure(measure).name
    return _late(shifted(values, mv.dim(d).name, n, unit, [m], suffix), late)


def _late(df: DataFrame, late) -> DataFrame:
    for cond in late:
        df = df.where(C.as_column(cond))
    return df


def same_period_last_year(mv, spark, measure, d, grain="month", dims=(), where=None, suffix="_prior"):
    """Value beside the value twelve months earlier (T7). Conditions on `d` apply after the lookup."""
    return date_shift(mv, spark, measure, d, -12, "month", grain, dims, where, suffix)


def yoy(mv, spark, measure, d, grain="month", dims=(), where=None, alternate=None) -> DataFrame:
    """Growth against the same period of the prior year, column `growth`."""
    m = mv.measure(measure).name
    df = same_period_last_year(mv, spark, measure, d, grain, dims, where)
    now, prior = F.col(f"`{m}`").cast("double"), F.col(f"`{m}_prior`").cast("double")
    growth = F.try_divide(now - prior, prior)
    return df.withColumn("growth", growth if alternate is None else F.coalesce(growth, F.lit(alternate)))


def ytd_vs_py(mv, spark, measure, d, dims=(), where=None) -> DataFrame:
    """Year-to-date, the prior year's, and the difference, per month.

    Months are completed first, so a prior year-to-date exists where only its last month is empty.
    """
    early, late = _split(mv, d, where)
    cells = _early(mv, spark, [measure], dims, d, "month", early)
    order, m = mv.dim(d).name, mv.measure(measure).name
    keys = [x for x in cells.dims if x != order]
    dense = replace(cells, df=densify(cells.df, order, "month", keys))
    dense = replace(dense, df=dense.df.withColumn("__year", F.year(F.col(f"`{order}`"))))
    ytd = dense.over(frame_text([*keys, "__year"], order, "UNBOUNDED PRECEDING AND CURRENT ROW")).values()
    out = shifted(ytd, order, -12, "month", [m], "_prior")
    return _late(out.withColumn("difference", F.col(f"`{m}`") - F.col(f"`{m}_prior`")), late)


def closing(mv, spark, measure, d, period="month", dims=(), where=None, first=False) -> DataFrame:
    """Value at the last (or first) date with facts of each period.

    Output columns: dims, `period`, `closing_date`, the measure.
    """
    values = _early(mv, spark, [measure], dims, d, "day", where).values()
    order, m = mv.dim(d).name, mv.measure(measure).name
    keys = [c for c in values.columns if c not in (order, m)]
    pick, edge = (F.min_by, F.min) if first else (F.max_by, F.max)
    day = F.col(f"`{order}`")
    return values.groupBy(*columns(keys), period_start(day, period).alias("period")).agg(
        edge(day).alias("closing_date"), pick(F.col(f"`{m}`"), day).alias(m)
    )


def semi_additive(mv, spark, measure, order, dims=(), how="last", where=None) -> DataFrame:
    """Measure at the last or first member of the order dimension, per group."""
    m = _with_window(mv, measure, Window(mv.dim(order).name, "current", how))
    return run(mv, spark, [m], dims, where)


def densify(df: DataFrame, order: str, unit: str, keys: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """Every period between the first and the last one for each key combination.

    Each combination generates its own dates, so nothing is paired beyond combination x calendar,
    which is the result itself. Bounds default to the whole range of the frame. The frame is settled,
    since its bounds, its combinations and its rows are all read.
    """
    df = settle(df)
    day = F.col(f"`{order}`")
    span = df.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    lo = F.lit(start).cast("date") if start else span["lo"]
    hi = F.lit(end).cast("date") if end else span["hi"]
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}
    step |= {"quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}
    combos = df.select(*columns(keys)).distinct() if keys else df.sparkSession.range(1).select()
    axis = combos.withColumn(order, F.explode(F.sequence(lo, hi, F.expr(step[unit]))))
    return C.join_on(axis, df, [*keys, order]).select(*columns(df.columns))


def lag(mv, spark, measure, d, n=1, unit="month", dims=(), where=None) -> DataFrame:
    """Value `n` members before on the completed axis, column `<measure>_lag`.

    A negative `n` looks ahead.
    """
    early, late = _split(mv, d, where)
    order, m = mv.dim(d).name, mv.measure(measure).name
    cells = _early(mv, spark, [measure], dims, d, unit, early).values()
    keys = [c for c in cells.columns if c not in (order, m)]
    dense = densify(cells, order, unit, keys)
    window = W.partitionBy(*columns(keys)).orderBy(F.col(f"`{order}`"))
    return _late(dense.withColumn(f"{m}_lag", F.lag(F.col(f"`{m}`"), n).over(window)), late)


def lead(mv, spark, measure, d, n=1, unit="month", dims=(), where=None) -> DataFrame:
    df = lag(mv, spark, measure, d, -n, unit, dims, where)
    m = mv.measure(measure).name
    return df.withColumnRenamed(f"{m}_lag", f"{m}_lead")
