"""Stratum bins and closed-form quota arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _in_range(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= 100)


def frequency_bin(value: Column) -> Column:
    """0 and 100 are their own bins; 20-point bins between, lower edge included."""
    v = value.cast("double")
    inner = F.floor(v / 20).cast("int") + 1
    return F.when(_in_range(v), F.when(v == 0, 0).when(v == 100, 6).otherwise(inner))


def frequency_bin_upper(value: Column) -> Column:
    """The older rule: upper edge included, so 20 falls in bin 1."""
    v = value.cast("double")
    inner = F.least(F.lit(5), F.ceil(v / 20).cast("int"))
    return F.when(_in_range(v), F.when(v == 0, 0).when(v == 100, 6).otherwise(inner))


def even_quota(total: Column, groups: int, index: Column) -> Column:
    """``total`` shared evenly; the first ``total % groups`` indexes take one more."""
    t = total.cast("bigint")
    return ((t - t % groups) / groups).cast("bigint") + F.when(index < t % groups, 1).otherwise(0)


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-7) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
