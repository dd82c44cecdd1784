"""Jan-1-anchored eight-day windows, context slots and solar geometry as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY = 86400

# Day offsets of the three context policies, half-open, relative to the target day.
CONTEXT_OFFSETS = {
    "centered_five": ((-16, -8), (-8, 0), (0, 8), (8, 16), (16, 24)),
    "past_four": ((-63, -47), (-47, -31), (-31, -15), (-15, 1)),
    "centered_four": ((-16, -8), (-8, 0), (0, 8), (8, 16)),
}


def first_of_year(day: Column, ahead: int = 0) -> Column:
    return F.make_date(F.year(day) + F.lit(ahead), F.lit(1), F.lit(1))


def window_start(day: Column, days: int = 8) -> Column:
    steps = F.floor((F.dayofyear(day) - 1) / F.lit(days)).cast("int")
    return F.date_add(first_of_year(day), steps * days)


def window_end(start: Column, days: int = 8) -> Column:
    """The last window of a year is short: it stops on January 1."""
    return F.least(F.date_add(start, days), first_of_year(start, 1))


def season(day: Column) -> Column:
    """``year:quarter`` with quarters counted from zero."""
    return F.concat_ws(":", F.year(day).cast("string"), (F.quarter(day) - 1).cast("string"))


def epoch(day: Column) -> Column:
    return F.unix_seconds(day.cast("timestamp"))


def parse_epoch(text: Column) -> Column:
    """ISO text to seconds; text without a zone is UTC."""
    return F.unix_seconds(F.try_to_timestamp(text))


def to_utc(local_s: Column, offset_hours: Column) -> Column:
    return local_s - (offset_hours * 3600).cast("bigint")


def calendar_windows(spark: SparkSession, start: str, end: str, as_of: str | None = None,
                     days: int = 8, context_days: int = 24) -> DataFrame:
    """Windows fully inside [start, end) whose right context has ended at ``as_of``."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    table = windows_between(bounds, F.col("a"), F.col("b"), days)
    if as_of is not None:
        closed = F.date_add("target_time", context_days).cast("timestamp") <= F.lit(as_of).cast("timestamp")
        table = table.filter(closed)
    return table.drop("a", "b")


def windows_between(df: DataFrame, start: Column, end: Column, days: int = 8) -> DataFrame:
    """One row per window lying inside each row's [start, end)."""
    years = F.explode(F.sequence(F.year(start), F.year(end))).alias("_year")
    out = df.select("*", years)
    first = F.make_date("_year", F.lit(1), F.lit(1))
    count = F.ceil((F.datediff(F.make_date(F.col("_year") + 1, F.lit(1), F.lit(1)), first)) / F.lit(days))
    out = out.select("*", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("_step"))
    out = out.withColumn("target_time", F.date_add(first, F.col("_step") * days))
    out = out.withColumn("target_end", window_end(F.col("target_time"), days))
    return out.filter((F.col("target_time") >= start) & (F.col("target_end") <= end)).drop("_year", "_step")


def windows_by_midpoint(spark: SparkSession, start: str, end: str, days: int = 8) -> DataFrame:
    """Windows whose midpoint lies in [start, end); their full bounds are kept."""
    wide = spark.range(1).select(
        F.date_sub(F.lit(start).cast("date"), days).alias("a"), F.date_add(F.lit(end).cast("date"), days).alias("b"))
    table = windows_between(wide, F.col("a"), F.col("b"), days).drop("a", "b")
    middle = (epoch(F.col("target_time")) + epoch(F.col("target_end"))) / 2
    return table.filter((middle >= epoch(F.lit(start).cast("date"))) & (middle < epoch(F.lit(end).cast("date"))))


def windows_by_start(spark: SparkSession, start: str, end: str, days: int = 8) -> DataFrame:
    wide = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.date_add(F.lit(end).cast("date"), days).alias("b"))
    table = windows_between(wide, F.col("a"), F.col("b"), days).drop("a", "b")
    return table.filter((F.col("target_time") >= F.lit(start).cast("date")) & (F.col("target_time") < F.lit(end).cast("date")))


def context_slots(df: DataFrame, target: Column, policy: str = "centered_five") -> DataFrame:
    """One row per context slot of each target day: ``slot``, ``slot_start``, ``slot_end``."""
    entries = [
        F.struct(F.lit(i).alias("slot"), F.date_add(target, a).alias("slot_start"), F.date_add(target, b).alias("slot_end"))
        for i, (a, b) in enumerate(CONTEXT_OFFSETS[policy])
    ]
    return df.select("*", F.inline(F.array(*entries)))


def assign_slot(target: Column, seen: Column, policy: str = "centered_five") -> Column:
    """Slot number of an observation day, NULL outside the context."""
    offset = F.datediff(seen, target)
    out = None
    for i, (a, b) in enumerate(CONTEXT_OFFSETS[policy]):
        hit = (offset >= a) & (offset < b)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def scene_time_bounds(start: Column, end: Column, instant: Column, days: Column) -> tuple[Column, Column]:
    """Explicit interval, else the instant itself, else ``days`` from it, never past the year's end."""
    left = F.coalesce(start, instant)
    span = F.least(F.date_add(left.cast("date"), days.cast("int")), first_of_year(left.cast("date"), 1)).cast("timestamp")
    right = F.when(end.isNotNull(), end).when(days.isNull(), instant).otherwise(span)
    return left, right


# NOAA general solar position equations, Fourier coefficients in the order
# constant, cos g, sin g, cos 2g, sin 2g, cos 3g, sin 3g; minutes of time (times 229.18) and radians.
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
SUNRISE_ZENITH_DEG = 90.833


def _solar_table() -> dict[str, str]:
    """Folded array constants over the days of a common year followed by those of a leap year."""
    def series(c, g):
        return sum(v * (1 if k == 0 else (math.cos if k % 2 else math.sin)(g * ((k + 1) // 2))) for k, v in enumerate(c))
    rows = []
    for length in (365, 366):
        for n in range(366):
            g = 2 * math.pi / length * n
            dec = series(DECLINATION, g)
            rows.append((229.18 * series(EQUATION_OF_TIME, g), math.sin(dec), math.cos(dec)))
    return {name: "cast(split('" + ",".join(repr(r[i]) for r in rows) + "', ',') as array<double>)"
            for i, name in enumerate(("eq", "sin", "cos"))}


_SOLAR = _solar_table()


def year_angle(day: Column) -> Column:
    """Fraction of the year in radians, from 0 on January 1."""
    length = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return (F.dayofyear(day) - 1) * F.lit(2 * math.pi) / length


def solar_series(angle: Column) -> tuple[Column, Column]:
    """Equation of time (minutes) and declination (radians) of a year angle."""
    def series(coefficients):
        total = F.lit(coefficients[0])
        for k, v in enumerate(coefficients[1:], 1):
            total = total + (F.cos if k % 2 else F.sin)(angle * ((k + 1) // 2)) * v
        return total
    return series(EQUATION_OF_TIME) * 229.18, series(DECLINATION)


def solar_terms(day: Column) -> tuple[Column, Column, Column]:
    """Equation of time (minutes) and sine and cosine of the declination, looked up by day of year."""
    leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
    at = F.dayofyear(day) - 1 + F.when(leap, 366).otherwise(0)
    return tuple(F.get(F.expr(_SOLAR[k]), at) for k in ("eq", "sin", "cos"))


def solar_structs(days: Column) -> Column:
    """Solar terms of an array of days, from one copy of the tables."""
    eq, sin, cos = (F.expr(_SOLAR[k]) for k in ("eq", "sin", "cos"))
    def of(day: Column) -> Column:
        leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
        at = F.dayofyear(day) - 1 + F.when(leap, 366).otherwise(0)
        return F.struct(day.alias("day"), F.get(eq, at).alias("eq"), F.get(sin, at).alias("sin"), F.get(cos, at).alias("cos"))
    return F.transform(days, of)


def hour_cosine(lat: Column, sin_dec: Column, cos_dec: Column) -> Column:
    """Cosine of the sunrise hour angle; at most -1 in polar day, at least 1 in polar night."""
    phi = F.radians(lat)
    return (F.lit(math.cos(math.radians(SUNRISE_ZENITH_DEG))) - F.sin(phi) * sin_dec) / F.greatest(
        F.lit(1e-15), F.cos(phi) * cos_dec)


def span_of_hour(day: Column, lon: Column, eq: Column, hour_cos: Column) -> tuple[Column, Column]:
    """Seconds of sunrise and sunset around local noon; the whole UTC day in polar day; NULL in polar night."""
    midnight = epoch(day)
    half = F.degrees(F.acos(hour_cos)) * 240
    noon = midnight + (F.lit(720) - lon * 4 - eq) * 60
    left = F.when(hour_cos >= 1, None).when(hour_cos <= -1, midnight.cast("double")).otherwise(noon - half)
    right = F.when(hour_cos >= 1, None).when(hour_cos <= -1, (midnight + DAY).cast("double")).otherwise(noon + half)
    return left, right


def daylight_span(day: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    eq, sin_dec, cos_dec = solar_terms(day)
    return span_of_hour(day, lon, eq, hour_cosine(lat, sin_dec, cos_dec))
