"""Calendar generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.functions.time import period


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day of a range with year, month, quarter and first day of the month."""
    return _days(spark.range(1).select(F.lit(start).cast("date").alias("lo"), F.lit(end).cast("date").alias("hi")))


def calendar_of(df: DataFrame, date: str) -> DataFrame:
    """Calendar over the whole years that a date column covers."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    first = F.date_trunc("year", "lo").cast("date")
    last = F.date_trunc("year", "hi").cast("date")
    return _days(span.select(first.alias("lo"), F.date_sub(F.add_months(last, 12), 1).alias("hi")))


def _days(span: DataFrame) -> DataFrame:
    d = F.col("date")
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(d, *[period(d, u).alias(u) for u in ("year", "month", "quarter", "month_start")])
