"""Integer and numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def floor_div(value: Column, step: int) -> Column:
    """Exact floor division of a LONG column by a positive integer."""
    step_col = F.lit(step).cast("long")
    return F.call_function("div", value - F.pmod(value, step_col), step_col)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division giving NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Division giving 0 for a zero or missing denominator."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """0 for NULL, NaN and both infinities."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(value.isNull() | F.isnan(value) | infinite, F.lit(0.0)).otherwise(value)


def one_row(stats: DataFrame) -> Column:
    """The single row of an aggregate as a struct, for use in another frame (scalar subquery)."""
    return stats.select(F.struct(*stats.columns)).scalar()
