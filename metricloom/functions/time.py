"""Calendar columns (T17, F11) and date shifts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How many days or months one unit spans.
DAYS = {"day": 1, "week": 7}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def period(c: Column, unit: str) -> Column:
    """Part of a date: year and month numbers, `Qn`, or the first day of the month."""
    if unit == "year":
        return F.year(c)
    if unit == "month":
        return F.month(c)
    if unit == "quarter":
        return F.concat(F.lit("Q"), F.quarter(c))
    if unit == "month_start":
        return period_start(c, "month")
    raise ValueError(f"unknown part of a date: {unit}")


def period_start(c: Column, unit: str) -> Column:
    if unit == "day":
        return c.cast("date")
    return F.date_trunc(unit, c).cast("date")


def shift(c: Column, n: int, unit: str) -> Column:
    """The date `n` units later (earlier when negative); month ends are clamped."""
    if unit in DAYS:
        return F.date_add(c, n * DAYS[unit])
    if unit in MONTHS:
        return F.add_months(c, n * MONTHS[unit])
    raise ValueError(f"cannot shift a date by {unit}")


def interval(n: int, unit: str) -> str:
    """SQL interval literal usable as a bound of a range frame."""
    if unit == "hour":
        return f"INTERVAL '{n}' HOUR"
    if unit in DAYS:
        return f"INTERVAL '{n * DAYS[unit]}' DAY"
    if unit in MONTHS:
        return f"INTERVAL '{n * MONTHS[unit]}' MONTH"
    raise ValueError(f"unknown unit: {unit}")
