"""Null-safe numbers, percentages and error measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hourlake.functions.times import col

_NUMBER = "([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)"


def safe_double(c: str | Column) -> Column:
    """A double, or null for null, blank and anything that is not a plain number.

    The pattern guards the cast: Spark would also read ``1d`` or ``NaN``.
    """
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(f"^{_NUMBER}$"), text).try_cast("double")


def leading_number(c: str | Column) -> Column:
    """The number a text starts with (``'12 mph'`` is 12), null when there is none."""
    text = F.regexp_extract(F.trim(col(c).cast("string")), f"^{_NUMBER}", 1)
    return F.nullif(text, F.lit("")).try_cast("double")


def pct(num: str | Column, den: str | Column, rule: str = "gt0") -> Column:
    """``num / den * 100``, null where the rule excludes the denominator.

    ``gt0`` needs a positive denominator, ``nullif`` any but zero, ``abs`` divides two magnitudes
    by anything but zero.
    """
    num, den = col(num), col(den)
    if rule == "gt0":
        return F.when(den > 0, num / den * 100)
    if rule == "nullif":
        return F.when(den != 0, num / den * 100)
    if rule == "abs":
        return F.when(den != 0, F.abs(num) / F.abs(den) * 100)
    raise ValueError(f"unknown rule {rule!r}")


def mape(actual: str | Column, forecast: str | Column) -> Column:
    """Mean absolute percentage error over the (signed) actual; zero actuals are left out."""
    a, f = col(actual), col(forecast)
    return F.avg(F.abs(a - f) / F.nullif(a, F.lit(0.0))) * 100


def rmse(actual: str | Column, forecast: str | Column) -> Column:
    return F.sqrt(F.avg((col(actual) - col(forecast)) * (col(actual) - col(forecast))))


def fahrenheit_to_celsius(c: str | Column) -> Column:
    return (col(c) - 32) * 5.0 / 9.0
