"""Availability reports and latest-composite selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landtally.functions.keys import SPLITS
from landtally.operators.draws import spaced_count


def availability(df: DataFrame, station: list[str], day: str, gap_days: int = 30, bins: int = 7) -> DataFrame:
    """Per split (and all together) and bin: stations, station windows and spaced capacity, zeros kept.

    Distinct station dates are formed once; every figure is an aggregate of that smaller table.
    """
    dates = df.select(*station, "split", "frequency_bin", day).distinct()
    per = dates.groupBy(*station, "split", "frequency_bin").agg(F.array_sort(F.collect_list(day)).alias("_days"))
    per = per.select("*", F.size("_days").alias("_w"), spaced_count(F.col("_days"), gap_days).alias("_c"))
    totals = per.groupingSets([["split", "frequency_bin"], ["frequency_bin"]], "split", "frequency_bin").agg(
        F.countDistinct(*station).alias("physical_stations"), F.sum("_w").alias("station_windows"), F.sum("_c").alias("capacity_30d"))
    totals = totals.withColumn("split", F.coalesce("split", F.lit("all")))
    spark = df.sparkSession
    cells = spark.range(bins).select(F.col("id").cast("int").alias("frequency_bin"), F.explode(F.array(*map(F.lit, ("all", *SPLITS)))).alias("split"))
    out = cells.join(totals, ["split", "frequency_bin"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("split", "frequency_bin", zero("physical_stations"), zero("station_windows"), zero("capacity_30d"))


def latest_composite(targets: DataFrame, scenes: DataFrame, day: str, start: str, days: int, ties: list[str]) -> DataFrame:
    """Newest scene whose [start, start + days) holds the target day; ``ties`` in rising order.

    Each scene is reduced to the best of its start day, and a start day reaches only the next
    ``days`` target days, so the join is an equi-join on dates.
    """
    rest = [c for c in scenes.columns if c != start]
    best = scenes.groupBy(start).agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("_s"))
    reach = best.withColumn(day, F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(day, F.date_add(start, F.col(day)))
    newest = reach.groupBy(day).agg(F.max_by(F.struct(F.col(start), F.col("_s")), start).alias("_b"))
    return targets.join(newest, day).select(*targets.columns, F.col(f"_b.{start}").alias(start), "_b._s.*")
