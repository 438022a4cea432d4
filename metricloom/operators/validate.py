"""Validation of views against direct SQL (V1-V6)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.functions.aggs import guard_division
from metricloom.plans import star
from metricloom.plans.model import Measure, MetricView

TOLERANCE = 0.01


def validation_cases(mv: MetricView, warned: Iterable[str] = ()) -> list[Measure]:
    """Measures worth checking: without windows and without warnings (V1)."""
    skipped = set(warned)
    return [mv.measure(m) for m in mv.measures if not m.window and m.name not in skipped]


def direct_query(mv: MetricView, spark: SparkSession, measures: Sequence[Measure], dims: Sequence = ()) -> DataFrame:
    """Measures as plain SQL over the source and all its joins, a plan of its own (V2)."""
    tables = {"__src": star.load(spark, mv.source), **{f"__j{i}": star.load(spark, j.source) for i, j in enumerate(mv.joins)}}
    order = star.needed_joins(mv, [f"{j.name}.x" for j in mv.joins])
    position = {j.name: i for i, j in enumerate(mv.joins)}
    joins = " ".join(f"LEFT JOIN {{__j{position[j.name]}}} AS {j.name} ON {j.condition()}" for j in order)
    structs = "".join(f", struct({j.name}.*) AS {j.name}" for j in order)
    grain = [mv.dim(d) for d in dims]
    shown = "".join(f"{d.expr} AS `{d.name}`, " for d in grain)
    where = f"WHERE {mv.filter}" if mv.filter else ""
    group = "GROUP BY ALL" if grain else ""
    rows = f"SELECT source.*{structs} FROM {{__src}} AS source {joins}"
    values = ", ".join(f"{guard_division(m.expr)} AS `{m.name}`" for m in measures)
    return spark.sql(f"SELECT {shown}{values} FROM ({rows}) AS source {where} {group}", **tables)


def passes(actual: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    """Numbers within the tolerance, relative above one; other values as trimmed texts (V3)."""
    a, e = actual.try_cast("double"), expected.try_cast("double")
    close = F.abs(a - e) <= F.lit(tolerance) * F.greatest(F.abs(e), F.lit(1.0))
    text = F.trim(actual.cast("string")) == F.trim(expected.cast("string"))
    none = actual.isNull() | expected.isNull()
    return F.when(none, actual.isNull() & expected.isNull()).otherwise(F.coalesce(close, text))


def compare_frames(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str] | Sequence[str],
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """All groups of both sides, compared measure by measure (V3-V5).

    `columns` maps the value columns of `actual` to those of `expected`. Both sides meet in one join,
    whatever the number of measures. Output: measure_name, keys, metric_view_value, expected_value,
    passed, error.
    """
    pairs = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}

    def side(df: DataFrame, mark: str, names: Iterable[str]) -> DataFrame:
        found = [F.col(f"`{k}`").alias(f"__{mark}{i}") for i, k in enumerate(keys)] or [F.lit(1).alias(f"__{mark}0")]
        return df.select(*found, F.struct(*[F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(names)]).alias(f"__{mark}"))

    left, right = side(actual, "a", pairs), side(expected, "e", pairs.values())
    on = F.lit(True)
    for i in range(max(len(keys), 1)):
        on = on & F.col(f"__a{i}").eqNullSafe(F.col(f"__e{i}"))
    both = left.join(right, on, "full")
    error = F.when(F.col("__a").isNull(), "view has no row for this group").when(
        F.col("__e").isNull(), "direct SQL has no row for this group"
    )
    results = [
        F.struct(
            F.lit(name).alias("measure_name"),
            F.col("__a")[f"v{i}"].cast("string").alias("metric_view_value"),
            F.col("__e")[f"v{i}"].cast("string").alias("expected_value"),
            (error.isNull() & passes(F.col("__a")[f"v{i}"], F.col("__e")[f"v{i}"], tolerance)).alias("passed"),
            error.alias("error"),
        )
        for i, name in enumerate(pairs)
    ]
    shown = [F.coalesce(f"__a{i}", f"__e{i}").alias(k) for i, k in enumerate(keys)]
    df = both.select(*shown, F.inline(F.array(*results)))
    rest = ["metric_view_value", "expected_value", "passed", "error"]
    return df.select("measure_name", *[F.col(f"`{k}`") for k in keys], *rest)


def validate_all(mv: MetricView, spark: SparkSession, dims: Sequence = (), warned: Iterable[str] = ()) -> DataFrame:
    """Every case in one frame (V6): one plan for the view, one for the direct SQL."""
    cases = validation_cases(mv, warned)
    keys = [mv.dim(d).name for d in dims]
    actual, expected = mv.query(spark, cases, dims), direct_query(mv, spark, cases, dims)
    return compare_frames(actual, expected, keys, [m.name for m in cases])
