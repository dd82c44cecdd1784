"""Interval series: overlap with calendar windows and daylight, quality-gated labels, closure audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landtally.functions import calendar as cal
from landtally.operators.ordered import exact_percentiles, neighbour, running

DAY = 86400
LATENT_HEAT = 2450000.0


def touch_windows(df: DataFrame, start_s: str = "start_s", end_s: str = "end_s", days: int = 8) -> DataFrame:
    """One row per calendar window an interval of at most one hour touches, with clipped bounds."""
    first = F.timestamp_seconds(F.col(start_s)).cast("date")
    last = F.timestamp_seconds(F.col(end_s) - 1).cast("date")
    spots = F.array_distinct(F.array(cal.window_start(first, days), cal.window_start(last, days)))
    out = df.withColumn("target_time", F.explode(spots)).withColumn(
        "target_end", cal.window_end(F.col("target_time"), days))
    left = F.greatest(F.col(start_s), cal.epoch(F.col("target_time")))
    right = F.least(F.col(end_s), cal.epoch(F.col("target_end")))
    return out.withColumn("left_s", left).withColumn("right_s", right).withColumn(
        "overlap_s", F.greatest(F.lit(0), F.col("right_s") - F.col("left_s")))


def window_spine(df: DataFrame, keys: list[str], start_s: str = "start_s", end_s: str = "end_s", days: int = 8,
                 whole: bool = False, as_of: str | None = None) -> DataFrame:
    """Every calendar window of each key's record, windows without a row included: keys, ``target_time``, ``target_end``.

    The record reaches from its first row to its last. ``whole`` leaves only windows that lie inside the days of the record, and
    ``as_of`` those whose right context of 24 days has ended by then.
    """
    day = lambda c: F.timestamp_seconds(c).cast("date")
    span = df.groupBy(*keys).agg(day(F.min(start_s)).alias("_first"), day(F.max(F.col(end_s)) - (0 if whole else 1)).alias("_last"))
    if whole:
        span = span.withColumn("_last", F.date_add("_last", 1))
    else:
        span = span.withColumn("_first", cal.window_start(F.col("_first"), days)).withColumn("_last", cal.window_end(cal.window_start(F.col("_last"), days), days))
    out = cal.windows_between(span.filter("_first is not null and _last is not null"), F.col("_first"), F.col("_last"), days).drop("_first", "_last")
    if as_of is not None:
        out = out.filter(F.date_add("target_time", 24).cast("timestamp") <= F.lit(as_of).cast("timestamp"))
    return out


def on_spine(spine: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of each window of the spine, 0 where it has no row."""
    on = [*keys, "target_time", "target_end"]
    parts = [c for c in sums.columns if c not in on]
    return spine.join(sums, on, "left").select(*on, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in parts])


def with_daylight(df: DataFrame, start: str, end: str, name: str = "day_s") -> DataFrame:
    """Daylight seconds inside a short interval; spans of the neighbouring UTC days can reach in.

    The spans are plain columns of the row, worked out in generated code: no calendar join, no shuffle. Overlapping spans of
    adjacent polar days count once.
    """
    lat, lon = F.col("lat"), F.col("lon")
    day = F.timestamp_seconds(F.col(start)).cast("date")
    # Each step's columns are used several times by the next, so every term is worked out once a row.
    near = (-2, -1, 0, 1)
    out = df.withColumns({f"_date{k + 2}": F.date_add(day, k) for k in near})
    out = out.withColumns({f"_angle{k}": cal.year_angle(F.col(f"_date{k}")) for k in range(4)})
    out = out.withColumns({f"_{n}{k}": c for k in range(4) for n, c in zip(("eq", "dec"), cal.solar_series(F.col(f"_angle{k}")))})
    out = out.withColumns({f"_hour{k}": cal.hour_cosine(lat, F.sin(f"_dec{k}"), F.cos(f"_dec{k}")) for k in range(4)})
    out = out.withColumns({f"_{n}{k}": c for k in range(4) for n, c in zip(
        ("rise", "set"), cal.span_of_hour(F.col(f"_date{k}"), lon, F.col(f"_eq{k}"), F.col(f"_hour{k}")))})
    total = F.lit(0.0)
    for k in (1, 2, 3):
        left = F.greatest(F.col(start), F.col(f"_rise{k}"), F.col(f"_set{k - 1}"))
        lit = F.greatest(F.lit(0.0), F.least(F.col(end), F.col(f"_set{k}")) - left)
        total = total + F.when(F.col(f"_set{k}").isNotNull(), lit).otherwise(0.0)
    return out.withColumn(name, total).drop(*[f"_{n}{k}" for n in ("date", "angle", "eq", "dec", "hour", "rise", "set") for k in range(4)])


def daylight_between(start: Column, end: Column, lat: Column, lon: Column) -> Column:
    """Daylight seconds of a window of days (evaluated once per aggregated window)."""
    first, last = F.timestamp_seconds(start).cast("date"), F.timestamp_seconds(end).cast("date")
    days = F.sequence(F.date_sub(first, 3), F.date_add(last, 2))
    def span(s: Column) -> Column:
        pair = cal.span_of_hour(s["day"], lon, s["eq"], cal.hour_cosine(lat, s["sin"], s["cos"]))
        return F.struct(*[c.alias(n) for c, n in zip(pair, "ab")])
    spans = F.transform(cal.solar_structs(days), span)
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("before"))
    def add(acc: Column, span: Column) -> Column:
        left = F.greatest(start.cast("double"), span["a"], acc["before"])
        part = F.when(span["b"].isNotNull(), F.greatest(F.lit(0.0), F.least(end.cast("double"), span["b"]) - left)).otherwise(0.0)
        return F.struct((acc["total"] + part).alias("total"), span["b"].alias("before"))
    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def daylight_spans(df: DataFrame, day: str, lat: str, lon: str) -> DataFrame:
    """One row per day with daylight: ``sun_left``, ``sun_right`` in epoch seconds."""
    left, right = cal.daylight_span(F.col(day), F.col(lat), F.col(lon))
    return df.withColumn("sun_left", left).withColumn("sun_right", right).filter(F.col("sun_left").isNotNull())


def merged_spans(df: DataFrame, keys: list[str], left: str, right: str, bucket_s: int = 600) -> DataFrame:
    """Union of touching spans per key. A span starts a new island when it begins past all earlier ends."""
    bucket, order = F.floor(F.col(left) / bucket_s), [F.col(left), F.col(right)]
    out = running(df.select(*keys, left, right), keys, order, right, "_reach", bucket, "max")
    out = out.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col(left) > F.col("_reach")), F.col(left)))
    out = running(out, keys, order, "_opens", "_island", bucket, "max", inclusive=True)
    return out.groupBy(*keys, F.col("_island")).agg(F.min(left).alias(left), F.max(right).alias(right)).drop("_island")


def label_sums(name: str, value: Column, good: Column, measured: Column) -> list[Column]:
    """Conditional sums from which one label variant is read."""
    use = good & value.isNotNull() & ~F.isnan(value) & (F.col("overlap_s") > 0)
    part = lambda c, cond=None: F.sum(F.when(use if cond is None else use & cond, c).otherwise(0.0))
    seconds = F.col("overlap_s").cast("double")
    return [
        part(value * seconds).alias(f"{name}_energy"), part(seconds).alias(f"{name}_effective"),
        part(seconds, measured).alias(f"{name}_measured"), part(F.col("day_s")).alias(f"{name}_day"),
        part(seconds - F.col("day_s")).alias(f"{name}_night"),
    ]


def label_columns(name: str, min_valid: float, min_measured: float, min_day_night: float,
                  full: Column, full_day: Column) -> dict[str, Column]:
    """Value, fractions over the whole window and ordered rejection reasons."""
    c = lambda part: F.col(f"{name}_{part}")
    full_night = full - full_day
    value = F.when(c("effective") > 0, c("energy") / c("effective") * (DAY / LATENT_HEAT))
    day = F.when(full_day > 1, c("day") / full_day)
    night = F.when(full_night > 1, c("night") / full_night)
    reasons = F.array_compact(F.array(
        F.when(c("effective") < full * min_valid, "effective_duration"),
        F.when(c("measured") < full * min_measured, "measured_duration"),
        F.when(day < min_day_night, "day_coverage"),
        F.when(night < min_day_night, "night_coverage"),
        F.when(value.isNull() | (value < 0), "missing_or_negative_window_et"),
    ))
    return dict(value=value, valid=F.size(reasons) == 0, reasons=reasons,
                valid_fraction=c("effective") / full, measured_fraction=c("measured") / full,
                filled_fraction=(c("effective") - c("measured")) / full,
                day_fraction=day, night_fraction=night)


def interval_labels(df: DataFrame, keys: list[str], value: str = "le", qc: str = "qc",
                    support: Column | None = None, min_valid: float = 0.8, min_measured: float = 0.5,
                    min_day_night: float = 0.8, spine: DataFrame | None = None) -> DataFrame:
    """Quality-gated window means of an interval series with ``start_s``, ``end_s``, ``lat``, ``lon``.

    Missing time is never a zero and never shrinks a denominator; a window of the record without any row is rejected with
    its reasons. ``spine`` names the windows (see :func:`window_spine`). The rows are shuffled once, on the window key,
    after partial aggregation.
    """
    good = F.col(qc).isin(0, 1) & (F.lit(True) if support is None else support)
    rows = with_daylight(touch_windows(df), "left_s", "right_s")
    group = [*keys, "lat", "lon", "target_time", "target_end"]
    sums = rows.groupBy(*group).agg(*label_sums("v", F.col(value), good, F.col(qc) == 0))
    site = [*keys, "lat", "lon"]
    sums = on_spine(window_spine(df, site) if spine is None else spine, sums, site)
    a, b = cal.epoch(F.col("target_time")), cal.epoch(F.col("target_end"))
    full = (b - a).cast("double")
    sums = sums.withColumn("full_s", full).withColumn(
        "full_day_s", F.least(full, daylight_between(a, b, F.col("lat"), F.col("lon"))))
    made = label_columns("v", min_valid, min_measured, min_day_night, F.col("full_s"), F.col("full_day_s"))
    return sums.select(*group, *[c.alias(n) for n, c in made.items()],
                       F.col("v_effective").alias("effective_seconds"), F.col("full_s").alias("window_seconds"))


def split_at_midnight(df: DataFrame, start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """An interval crossing midnight becomes two rows with the same mean."""
    midnight = (F.floor(F.col(start_s) / DAY) + 1) * DAY
    piece = lambda a, b: F.struct(a.cast("bigint").alias("_a"), b.cast("bigint").alias("_b"))
    parts = F.when(F.col(end_s) > midnight, F.array(piece(F.col(start_s), midnight), piece(midnight, F.col(end_s)))
                   ).otherwise(F.array(piece(F.col(start_s), F.col(end_s))))
    out = df.withColumn("_part", F.explode(parts))
    return out.withColumn(start_s, F.col("_part._a")).withColumn(end_s, F.col("_part._b")).drop("_part")


def daily_support(df: DataFrame, keys: list[str], valid: Column, name: str, coverage: float = 0.75,
                  start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """Valid rows of days whose valid seconds reach ``coverage`` of the whole day.

    The window is one key and one local day: at most a day of half hours.
    """
    day = F.floor(F.col(start_s) / DAY)
    seconds = F.sum(F.when(valid, F.col(end_s) - F.col(start_s)).otherwise(0)).over(
        Window.partitionBy(*keys, day))
    return df.withColumn(name, valid & (seconds >= coverage * DAY))


def paired_labels(df: DataFrame, keys: list[str], offset_s: str) -> DataFrame:
    """Raw, corrected and raw-on-corrected-support labels for the same windows, in one aggregation.

    Input bounds are local standard time; days are local, windows are UTC. Windows of the record without rows are rejected like others.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    local = split_at_midnight(df)
    raw_good = finite("le") & F.col("qc").isin(0, 1)
    local = daily_support(local, keys, raw_good, "raw_mask")
    local = daily_support(local, keys, raw_good & finite("le_corr"), "corrected_mask")
    utc = local.withColumn("start_s", F.col("start_s") - F.col(offset_s)).withColumn("end_s", F.col("end_s") - F.col(offset_s))
    rows = with_daylight(touch_windows(utc), "left_s", "right_s")
    group = [*keys, "lat", "lon", "target_time", "target_end"]
    sums = rows.groupBy(*group).agg(
        *label_sums("raw", F.col("le"), F.col("raw_mask"), F.col("qc") == 0),
        *label_sums("corrected", F.col("le_corr"), F.col("corrected_mask"), F.col("qc") == 0),
        *label_sums("matched", F.col("le"), F.col("corrected_mask"), F.col("qc") == 0))
    site = [*keys, "lat", "lon"]
    sums = on_spine(window_spine(utc, site), sums, site)
    a, b = cal.epoch(F.col("target_time")), cal.epoch(F.col("target_end"))
    full = (b - a).cast("double")
    sums = sums.withColumn("full_s", full).withColumn(
        "full_day_s", F.least(full, daylight_between(a, b, F.col("lat"), F.col("lon"))))
    made = {n: label_columns(n, 0.0, 0.5, 0.75, F.col("full_s"), F.col("full_day_s")) for n in ("raw", "corrected", "matched")}
    return sums.select(
        *group, made["raw"]["valid"].alias("raw_valid"), made["corrected"]["valid"].alias("corrected_valid"),
        made["raw"]["value"].alias("raw_value"), made["corrected"]["value"].alias("corrected_value"),
        made["matched"]["value"].alias("raw_matched_value"),
        F.array_join(made["raw"]["reasons"], ",").alias("raw_reasons"),
        F.array_join(made["corrected"]["reasons"], ",").alias("corrected_reasons"),
        *[made["corrected"][f].alias(f"corrected_{f}") for f in ("valid_fraction", "measured_fraction", "day_fraction", "night_fraction")])


ENERGY_MODES = ("measured_all", "measured_day", "measured_goodfill_all", "measured_goodfill_day")


def energy_closure(df: DataFrame, station: str) -> DataFrame:
    """Energy balance ratio per station and mode on a common validity mask.

    Columns: start_s, end_s, le, h, g, netrad, sw_in and their *_qc. All modes come from one pass:
    month sums first, then the station.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    seconds = (F.col("end_s") - F.col("start_s")).cast("double")
    sums, masks = [], {}
    for mode in ENERGY_MODES:
        codes = (0, 1) if "goodfill" in mode else (0,)
        mask = finite("netrad") & (seconds > 0) & (seconds <= 3600)
        for c in ("le", "h", "g"):
            mask = mask & finite(c) & F.col(f"{c}_qc").isin(*codes)
        if mode.endswith("_day"):
            mask = mask & (F.col("sw_in") > 20) & F.col("sw_in_qc").isin(*codes)
        masks[mode] = mask
        pick = lambda c, mask=mask: F.when(mask, c)
        sums += [F.sum(pick((F.col("le") + F.col("h")) * seconds)).alias(f"{mode}_num"),
                 F.sum(pick((F.col("netrad") - F.col("g")) * seconds)).alias(f"{mode}_den"),
                 F.count(pick(F.lit(1))).alias(f"{mode}_n"), F.sum(pick(seconds)).alias(f"{mode}_s"),
                 F.min(pick(F.col("start_s"))).alias(f"{mode}_first"), F.max(pick(F.col("start_s"))).alias(f"{mode}_last")]
    month = F.date_format(F.timestamp_seconds("start_s"), "yyyy-MM")
    monthly = df.groupBy(station, month.alias("_month")).agg(*sums)
    records = []
    for mode in ENERGY_MODES:
        c = lambda part, mode=mode: F.col(f"{mode}_{part}")
        records.append(F.struct(
            F.lit(mode).alias("mode"), F.coalesce(F.sum(c("num")), F.lit(0.0)).alias("num"),
            F.coalesce(F.sum(c("den")), F.lit(0.0)).alias("den"), F.sum(c("n")).alias("n"),
            F.coalesce(F.sum(c("s")), F.lit(0.0)).alias("s"), F.min(c("first")).alias("first"), F.max(c("last")).alias("last"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(c("n") > 0, F.struct(F.col("_month"), c("n")))))).alias("months")))
    wide = monthly.groupBy(station).agg(F.array(*records).alias("_modes"))
    rows = wide.select(station, F.inline("_modes"))
    ebr = F.when(F.col("den") > 0, F.col("num") / F.col("den"))
    span = F.coalesce((F.col("last") - F.col("first")) / DAY, F.lit(0.0))
    status = (F.when(span <= 365.25, "insufficient_record_span").when(ebr.isNull(), "unassessable_energy")
              .when(ebr > 0.75, "pass").otherwise("fail"))
    return rows.select(station, "mode", ebr.alias("ebr"), F.col("num").alias("numerator_j_m2"),
                       F.col("den").alias("denominator_j_m2"), F.col("n").alias("valid_intervals"),
                       (F.col("s") / 3600).alias("valid_hours"), span.alias("common_span_days"),
                       F.col("months").alias("monthly_intervals"), status.alias("status"))


def bowen_preservation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95th percentile of the relative cross-product error of corrected fluxes."""
    num = F.abs(F.col("h_corr") * F.col("le") - F.col("h") * F.col("le_corr"))
    den = F.abs(F.col("h_corr") * F.col("le")) + F.abs(F.col("h") * F.col("le_corr"))
    stable = df.withColumn("_error", F.when(den > 1.0, num / den)).filter(F.col("_error").isNotNull())
    table = exact_percentiles(stable, keys, "_error", [0.5, 0.95])
    return table.groupBy(*keys).agg(
        F.max("n").alias("intervals"), F.max(F.when(F.col("p") == 0.5, F.col("percentile"))).alias("median"),
        F.max(F.when(F.col("p") == 0.95, F.col("percentile"))).alias("p95"))


def nearest_mornings(df: DataFrame, keys: list[str], time: str = "t_s", lon: str = "lon",
                     tolerance_s: int = 3600) -> DataFrame:
    """Nearest good observation to mean-solar 06:00 of each day; ties take the earlier one.

    A minimum over (distance, time) aggregates before the shuffle, so a busy sensor costs nothing extra.
    """
    shift = F.lit(6 * 3600.0) - F.col(lon) * 240
    day = F.round((F.col(time) - shift) / DAY).cast("bigint")
    ideal = day * DAY + shift
    window = lambda s: cal.window_start(F.timestamp_seconds(F.floor(s)).cast("date"))
    usable = (F.col("good") & F.col("value").isNotNull() & ~F.isnan("value") & F.col("value").between(0, 1)
              & (F.abs(F.col(time) - ideal) <= tolerance_s))
    rows = df.filter(usable).withColumn("solar_day", day).withColumn("target_time", window(ideal))
    rows = rows.filter(window(F.col(time)) == F.col("target_time"))
    best = F.min(F.struct(F.abs(F.col(time) - ideal).alias("gap"), F.col(time).alias("utc"), F.col("value"), (F.col(time) - ideal).alias("offset_seconds")))
    out = rows.groupBy(*keys, lon, "solar_day", "target_time").agg(best.alias("m"))
    return out.select(*keys, lon, F.date_add(F.lit("1970-01-01").cast("date"), F.col("solar_day").cast("int")).alias("solar_date"),
                      "target_time", "m.utc", "m.value", "m.offset_seconds")


def expected_mornings(start_s: Column, end_s: Column, lon: Column) -> Column:
    """Number of mean-solar 06:00 instants in [start, end)."""
    shift = F.lit(6 * 3600.0) - lon * 240
    return (F.ceil((end_s - shift) / DAY) - F.ceil((start_s - shift) / DAY)).cast("bigint")


def morning_means(mornings: DataFrame, keys: list[str], lon: str = "lon", coverage: float = 0.8, spine: DataFrame | None = None) -> DataFrame:
    """Mean of the chosen mornings per window. With a ``spine`` of (keys, lon, target_time) windows without one count 0 days."""
    group = [*keys, lon, "target_time"]
    out = mornings.groupBy(*group).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("valid_days"))
    if spine is not None:
        out = spine.select(*group).join(out, group, "left").withColumn("valid_days", F.coalesce("valid_days", F.lit(0)).cast("bigint"))
    end = cal.window_end(F.col("target_time"))
    out = out.withColumn("target_end", end).withColumn(
        "expected_days", expected_mornings(cal.epoch(F.col("target_time")), cal.epoch(end), F.col(lon)))
    return out.withColumn("valid", (F.col("valid_days") > 0) & (F.col("valid_days") >= F.col("expected_days") * coverage))


def interval_violations(df: DataFrame, keys: list[str], bucket_s: int = DAY) -> DataFrame:
    """Rows that are not positive, exceed an hour, or overlap their successor."""
    out = neighbour(df, keys, "start_s", "start_s", "next_start_s", bucket_s)
    reason = (F.when(F.col("end_s") <= F.col("start_s"), "nonpositive")
              .when(F.col("end_s") - F.col("start_s") > 3600, "longer_than_hour")
              .when(F.col("next_start_s") < F.col("end_s"), "overlap"))
    return out.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def median_step(df: DataFrame, keys: list[str], time: str = "t_s", bucket_s: int = 600) -> DataFrame:
    """Median spacing per key from a histogram of step lengths."""
    steps = neighbour(df, keys, time, time, "_next", bucket_s).select(*keys, (F.col("_next") - F.col(time)).alias("_step"))
    table = exact_percentiles(steps, keys, "_step", [0.5])
    return table.select(*keys, F.col("n").alias("steps"), F.col("percentile").alias("median_step_s"))
