"""Eligibility rules of labels and observations. Unknown never counts as good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def observed_occurrence(value: Column, observations: Column) -> tuple[Column, Column]:
    """A missing occurrence is a never-water zero only with valid observations; else a reason."""
    seen = F.coalesce(observations, F.lit(0)) > 0
    number = F.coalesce(value, F.when(seen, F.lit(0.0)))
    return number, F.when(number.isNull(), "unobserved")


def sm_support_eligible(known: Column, water_ice: Column, threshold: float = 0.95, limit: float = 0.05) -> Column:
    k = F.coalesce(known, F.lit(0.0))
    return (k > threshold) & (F.coalesce(water_ice, F.lit(1.0)) + (1 - k) < limit)


def sm_eligible(grid: Column, footprint: Column, valid_days: Column, value: Column) -> Column:
    """Grid and footprint supports pass independently."""
    ok = sm_support_eligible(grid["known"], grid["water_ice"]) & sm_support_eligible(footprint["known"], footprint["water_ice"])
    return ok & (F.coalesce(valid_days, F.lit(0)) > 0) & value.isNotNull() & ~F.isnan(value)


def sm_tile_land(land_known: Column, cells: int = 1600) -> Column:
    """Aggregate: mean of land * known over every cell of the tile."""
    return F.sum(F.coalesce(land_known, F.lit(0.0))) / cells


def is_centre(height: int, width: int) -> Column:
    return (F.col("row") == height // 2) & (F.col("col") == width // 2)


def accept_observations(df: DataFrame, keys: list[str], slot: str, time: str, target: Column, slots: int, days: float | None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.countDistinct(slot).alias("_n"), F.max(time).alias("_last"))
    ok = F.col("_n") >= slots
    if days is not None:
        ok = ok & ((target - F.col("_last")) / 86400 <= days)
    return out.select(*keys, ok.alias("accepted"))


def relaxed_counts(df: DataFrame, keys: list[str], age_days: Column, before: float, after: float) -> DataFrame:
    """Accepted rows under the old and the new limit; the limit may only be relaxed."""
    if after < before:
        raise ValueError("the age limit may only be relaxed")
    n = lambda limit: F.count(F.when(age_days <= limit, 1))
    return df.groupBy(*keys).agg(n(before).alias("accepted_before"), n(after).alias("accepted_after"))


def first_reason(rules: dict[str, Column]) -> Column:
    """Name of the first rule that holds, NULL when none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])


def lst_eligible(valid: Column, value: Column, uncertainty: Column, observed: Column, limit: float = 2.0) -> Column:
    return F.coalesce(valid & value.isNotNull() & ~F.isnan(value) & uncertainty.between(0, limit) & observed, F.lit(False))


def display_value(value: Column, valid: Column, surface: Column, threshold: float) -> Column:
    return F.when(valid & (surface >= threshold), value)


def causal_latest(df: DataFrame, keys: list[str], time: str, target_day: Column, tie: str) -> DataFrame:
    """Latest observation per key before the end of the target day: a ``max`` aggregate."""
    end = F.unix_seconds(F.date_add(target_day, 1).cast("timestamp"))
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(F.col(time) < end).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(time).alias("a"), F.col(tie).alias("b"))).alias("_b"))
    return best.select(*keys, "_b.*")


def explode_observations(df: DataFrame, sample: str, observations: str, cohort: Column, task: Column) -> DataFrame:
    """One row per valid observation, keyed cohort:sample:task:index; the index counts every observation."""
    out = df.select(sample, F.posexplode(observations).alias("_i", "_o")).filter("_o.valid")
    key = F.concat_ws(":", cohort, F.col(sample), task, F.col("_i").cast("string"))
    return out.select(key.alias("key"), sample, F.col("_i").alias("observation"), F.col("_o.value").alias("value"))


def level2_asset(asset: Column) -> Column:
    """``collection_L1/id`` to ``collection_L2/id``; anything else is NULL."""
    head, tail = F.substring_index(asset, "/", 3), F.substring_index(asset, "/", -1)
    return F.when(head.endswith("_L1") & (F.length(tail) > 0), F.concat(F.regexp_replace(head, "_L1$", "_L2"), F.lit("/"), tail))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray crossing against a fixed ring; boundary points on lower edges count as inside."""
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 == y1:
            continue
        crosses = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
        at = F.lit(float(x0)) + (y - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0))
        inside = inside != (crosses & (x < at))
    return F.coalesce(inside, F.lit(False))
