"""Pixel tables: compositing, cover targets, alignment, coarse aggregation and weighted mosaics.

Pixels are long rows (tile, row, col, ...). Every aggregate is a plain ``groupBy`` with partial
aggregation; the small per-tile shapes (a 3x3 block, a day) never gather in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def daily_mean(df: DataFrame, keys: list[str], day: str, value: str = "value", valid: str = "valid") -> DataFrame:
    """One vote per UTC day and pixel."""
    return df.filter(F.col(valid)).groupBy(*keys, day).agg(F.avg(value).alias(value))


def slot_composite(daily: DataFrame, keys: list[str], start: str, day: str, value: str = "value") -> DataFrame:
    """Mean of daily means in a slot, number of days, and mean, first and last day offsets."""
    offset = F.datediff(F.col(day), F.col(start))
    return daily.groupBy(*keys, start).agg(
        F.avg(value).alias("value"), F.count(F.lit(1)).alias("days"), F.avg(offset).alias("mean_day"),
        F.min(offset).alias("first_day"), F.max(offset).alias("last_day"))


def fill_slots(grid: DataFrame, composite: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected pixel and slot; missing ones are zero and not valid."""
    out = grid.join(composite, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(*keys, zero("value").alias("value"), F.coalesce("days", F.lit(0)).alias("days"),
                      (F.coalesce("days", F.lit(0)) > 0).alias("valid"))


def cover_composite(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Means of daily class votes over known days, and the unknown share of observed days.

    Input has one row per image and pixel: observed, known, water, snow_ice, land (booleans).
    """
    number = lambda c: F.col(c).cast("double")
    seen = df.filter("observed")
    known = F.col("known")
    daily = seen.groupBy(*keys, day).agg(
        *[F.avg(F.when(known, number(c))).alias(c) for c in ("water", "snow_ice", "land")],
        F.avg(1 - number("known")).alias("unknown"))
    return daily.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("water", "snow_ice", "land")], F.count("water").alias("days"),
        (F.count("water") > 0).alias("known"), F.count(F.lit(1)).alias("observed_days"), F.avg("unknown").alias("unknown_fraction"))


def block_means(df: DataFrame, keys: list[str], values: list[str], factor: int = 3, row: str = "row", col: str = "col") -> DataFrame:
    """Mean over factor x factor blocks; a missing pixel counts as zero in the full denominator."""
    out = df.withColumn("out_row", F.floor(F.col(row) / factor).cast("int")).withColumn("out_col", F.floor(F.col(col) / factor).cast("int"))
    cells = float(factor * factor)
    return out.groupBy(*keys, "out_row", "out_col").agg(
        *[(F.sum(F.coalesce(F.col(v), F.lit(0.0))) / cells).alias(v) for v in values])


def cover_targets(df: DataFrame, keys: list[str], threshold: float = 0.95, factor: int = 3) -> DataFrame:
    """Class fractions over known area; valid only where the known fraction exceeds the threshold."""
    classes = ("water", "snow_ice", "land")
    known = F.col("known").cast("double")
    rows = df.withColumn("cover_known", known)
    for c in classes:
        rows = rows.withColumn(c, F.col(c) * known)
    out = block_means(rows, keys, ["cover_known", *classes], factor)
    for c in classes:
        out = out.withColumn(c, F.col(c) / F.greatest(F.col("cover_known"), F.lit(1e-6)))
    return out.withColumn("valid", F.col("cover_known") > threshold)


def nearest_index(target: Column, source_n: int, target_n: int) -> Column:
    """Source index whose cell contains the centre of a target cell."""
    return F.floor(((target * 2 + 1) * source_n) / F.lit(2 * target_n)).cast("int")


def align_nearest(target: DataFrame, source: DataFrame, keys: list[str], source_n: int, target_n: int) -> DataFrame:
    """Join a coarser grid onto target pixels by nearest index."""
    t = target.withColumn("_sr", nearest_index(F.col("row"), source_n, target_n)).withColumn("_sc", nearest_index(F.col("col"), source_n, target_n))
    s = source.withColumnRenamed("row", "_sr").withColumnRenamed("col", "_sc")
    return t.join(s, [*keys, "_sr", "_sc"]).drop("_sr", "_sc")


def sensor_mask(df: DataFrame, keys: list[str], valid: str = "valid") -> DataFrame:
    """A pixel of a sensor is valid only if every band group is."""
    return df.groupBy(*keys).agg((F.min(F.col(valid).cast("int")) == 1).alias(valid))


def active_slots(df: DataFrame, tile: str, slot: str, sensor: str, minimum: float, needed: int, valid: str = "valid") -> DataFrame:
    """Slots in which some sensor's valid fraction reaches ``minimum``; eligible with ``needed`` of them."""
    share = df.groupBy(tile, slot, sensor).agg(F.avg(F.col(valid).cast("double")).alias("_share"))
    best = share.groupBy(tile, slot).agg(F.max("_share").alias("_best"))
    out = best.groupBy(tile).agg(F.sum(F.when(F.col("_best") >= minimum, 1).otherwise(0)).alias("active"))
    return out.withColumn("eligible", F.col("active") >= needed)


def prediction_support(df: DataFrame, tile: str, valid: str = "valid", factor: int = 3) -> DataFrame:
    """A 30 m cell is supported iff each of its nine pixels is seen by some sensor and slot."""
    seen = df.groupBy(tile, "row", "col").agg(F.max(F.col(valid).cast("int")).alias("_v"))
    out = seen.withColumn("out_row", F.floor(F.col("row") / factor).cast("int")).withColumn("out_col", F.floor(F.col("col") / factor).cast("int"))
    agg = out.groupBy(tile, "out_row", "out_col").agg(F.sum("_v").alias("_s"))
    return agg.select(tile, "out_row", "out_col", (F.col("_s") == factor * factor).alias("supported"))


def temperature_blocks(df: DataFrame, tile: str, factor: int = 3) -> DataFrame:
    """All nine pixels clear: mean temperature and the greatest uncertainty."""
    out = df.withColumn("out_row", F.floor(F.col("row") / factor).cast("int")).withColumn("out_col", F.floor(F.col("col") / factor).cast("int"))
    agg = out.groupBy(tile, "out_row", "out_col").agg(
        F.sum(F.col("clear").cast("int")).alias("_n"), F.avg("temperature").alias("_t"), F.max("uncertainty").alias("_u"))
    ok = F.col("_n") == factor * factor
    return agg.select(tile, "out_row", "out_col", ok.alias("valid"), F.when(ok, F.col("_t")).alias("temperature"),
                      F.when(ok, F.col("_u")).alias("uncertainty"))


def project_operator(weights: DataFrame, field: DataFrame, keys: list[str], cell: list[str], atol: float = 1e-5) -> DataFrame:
    """Sum of weight * field; valid only with a complete support and weights that sum to one."""
    j = weights.filter("weight > 0").join(field, [*keys, *cell], "left")
    out = j.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.sum("weight").alias("weight"),
                               F.min(F.when(F.coalesce("valid", F.lit(False)), 1).otherwise(0)).alias("_ok"))
    valid = (F.col("_ok") == 1) & (F.abs(F.col("weight") - 1) <= atol)
    return out.select(*keys, F.when(valid, F.col("value")).alias("value"), "weight", valid.alias("valid"))


def total_by_cover(fractions: list[Column], values: list[Column]) -> Column:
    """Sum of fraction * value; a zero fraction ignores whatever its value is."""
    total = F.lit(0.0)
    for f, v in zip(fractions, values):
        total = total + F.when(f == 0, 0.0).otherwise(f * v)
    return total


def land_weighted_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Soil-moisture window mean with weights 1 - water - ice on known domain pixels."""
    w = F.when(F.col("known") & F.col("domain"), F.greatest(F.lit(0.0), 1 - F.col("water") - F.col("snow_ice"))).otherwise(0.0)
    out = df.withColumn("_w", w).groupBy(*keys).agg(F.sum("_w").alias("land_weight"), F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("value"))).alias("_v"))
    return out.select(*keys, "land_weight", F.when(F.col("land_weight") > 0, F.col("_v") / F.col("land_weight")).alias("value"))


def hann(index: Column, size: int) -> Column:
    """Inner points of a Hann window of ``size`` + 2, so that every pixel has weight."""
    return F.pow(F.sin((index + 1) * F.lit(3.141592653589793 / (size + 1))), F.lit(2))


def blend(df: DataFrame, keys: list[str], size: int, value: str = "value", surface: str | None = None) -> DataFrame:
    """Overlapping window predictions blended with a separable Hann kernel; nothing is filled.

    ``surface`` weights conditional variables by the fraction they describe.
    """
    w = hann(F.col("win_row"), size) * hann(F.col("win_col"), size)
    if surface:
        w = w * F.col(surface)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_w", w).filter("_w > 0")
    v = F.col(value)
    out = rows.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * v).alias("_v"),
                                  F.sum(F.col("_w") * v * v).alias("_vv"), F.count(F.lit(1)).alias("windows"))
    mean = F.col("_v") / F.col("_w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_vv") / F.col("_w") - mean * mean))
    return out.select(*keys, mean.alias(value), F.when(F.col("windows") > 1, spread).alias("spread"), "windows")


def static_weights(df: DataFrame, first: int = 17, count: int = 7) -> DataFrame:
    """Uniform weights of the fixed square support for each row of ``df``."""
    span = F.sequence(F.lit(first), F.lit(first + count - 1))
    out = df.withColumn("out_row", F.explode(span)).withColumn("out_col", F.explode(span))
    return out.withColumn("weight", F.lit(1.0 / (count * count)))


def area_series(df: DataFrame, day: str) -> DataFrame:
    """Area totals per date: water km2, mean ET over valid area, land-weighted soil moisture, coverage."""
    a = F.col("area_m2")
    on = lambda flag, c: F.sum(F.when(F.col(flag), c).otherwise(0.0))
    sm_on = F.col("sm_valid") & (F.col("land") > 0)
    out = df.groupBy(day).agg(
        F.sum(a).alias("_a"), on("cover_valid", F.col("water") * a).alias("_water"), on("cover_valid", a).alias("_cover"),
        on("et_valid", F.col("et") * a).alias("_et"), on("et_valid", a).alias("_eta"),
        F.sum(F.when(sm_on, F.col("sm") * F.col("land") * a).otherwise(0.0)).alias("_sm"),
        F.sum(F.when(sm_on, F.col("land") * a).otherwise(0.0)).alias("_sml"))
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    return out.select(day, (F.col("_water") / 1e6).alias("water_km2"), ratio("_et", "_eta").alias("et"), ratio("_sm", "_sml").alias("sm"),
                      ratio("_cover", "_a").alias("cover_fraction"), ratio("_eta", "_a").alias("et_fraction"))


def area_weighted(df: DataFrame, keys: list[str], value: str, area: str) -> DataFrame:
    """Weighted mean over the whole region; masked pixels count as zero."""
    return df.groupBy(*keys).agg((F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(area)) / F.sum(area)).alias("quality"))


def static_quality(df: DataFrame, keys: list[str], expected: str, confidence: float, valid_fraction: float,
                   homogeneous: float, cells: int = 441) -> DataFrame:
    """Dominant confident class over the full support; missing cells stay in the denominator."""
    seen = F.col("observed")
    confident = seen & (F.col("probability") >= confidence)
    counts = [F.sum(F.when(confident & (F.col("label") == c), 1).otherwise(0)).alias(f"_c{c}") for c in range(9)]
    out = df.groupBy(*keys, expected).agg(*counts, F.sum(seen.cast("int")).alias("_seen"))
    votes = F.array(*[F.col(f"_c{c}") for c in range(9)])
    out = out.withColumn("dominant", (F.array_position(votes, F.array_max(votes)) - 1).cast("int"))
    out = out.withColumn("homogeneous_fraction", F.array_max(votes) / float(cells)).withColumn("valid_fraction", F.col("_seen") / float(cells))
    reasons = F.array_compact(F.array(
        F.when(F.col("valid_fraction") < valid_fraction, "insufficient_contemporary_classification_coverage"),
        F.when(F.col("homogeneous_fraction") < homogeneous, "insufficient_homogeneous_whole_area"),
        F.when(F.size(expected) == 0, "unresolved_source_landcover")
         .when(~F.array_contains(F.col(expected), F.col("dominant")), "source_landcover_disagreement")))
    return out.select(*keys, "dominant", "homogeneous_fraction", "valid_fraction", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def nearest_scenes(df: DataFrame, keys: list[str], time: str, target: str, scene: str, extra: list[Column] = ()) -> DataFrame:
    """Per key the scene nearest in time, newer on a tie, then by id. A ``min`` aggregate, no window."""
    order = F.struct(*extra, F.abs(F.col(time) - F.col(target)).alias("_gap"), (-F.col(time)).alias("_new"), F.col(scene).alias("_scene"))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*")


def anchored_orbit_scenes(df: DataFrame, keys: list[str], slot: str, time: str, target: str, scene: str,
                          orbit: str) -> DataFrame:
    """The nearest radar scene of the whole context fixes the orbit; each slot then takes its nearest scene of it."""
    anchor = nearest_scenes(df, keys, time, target, scene).select(*keys, F.col(orbit).alias("_orbit"))
    same = df.join(anchor, keys).filter(F.col(orbit) == F.col("_orbit")).drop("_orbit")
    return nearest_scenes(same, [*keys, slot], time, target, scene)


def carried_orbit_scenes(df: DataFrame, keys: list[str], slot: str, slots: int, time: str, target: str, scene: str,
                         orbit: str) -> DataFrame:
    """Older policy: slots from last to first, each later choice passing its orbit on.

    One aggregate keeps the best scene of every (slot, orbit); a place then has at most slots times orbits of them, and one fold
    over that list makes all choices.
    """
    order = F.struct(F.abs(F.col(time) - F.col(target)).alias("gap"), (-F.col(time)).alias("new"), F.col(scene).alias("scene"))
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(F.col(slot).between(0, slots - 1)).groupBy(*keys, slot, orbit).agg(F.min_by(F.struct(*rest), order).alias("row"), F.min(order).alias("order"))
    places = best.groupBy(*keys).agg(F.collect_list(F.struct("order", F.col(slot).alias("slot"), F.col(orbit).alias("orbit"), "row")).alias("all"))
    row = best.schema["row"].dataType.simpleString()
    held = F.struct(F.lit(None).cast(best.schema[orbit].dataType).alias("orbit"), F.array().cast(f"array<{row}>").alias("out"))

    def choose(a: Column, s: Column) -> Column:
        usable = F.filter("all", lambda x: (x["slot"] == s) & (a["orbit"].isNull() | (x["orbit"] == a["orbit"])))
        first = F.array_sort(usable, lambda x, y: F.when(x["order"] < y["order"], -1).when(x["order"] > y["order"], 1).otherwise(0))[0]
        return F.struct(F.coalesce(first["orbit"], a["orbit"]).alias("orbit"), F.array_compact(F.array_append(a["out"], first["row"])).alias("out"))

    chosen = F.aggregate(F.sequence(F.lit(slots - 1), F.lit(0), F.lit(-1)), held, choose, lambda a: a["out"])
    return places.select(*keys, F.inline(chosen)).select(*df.columns)


def orbit_majority(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Most frequent orbit and pass; a tie takes the smallest label."""
    label = F.concat_ws("/", *[F.col(p).cast("string") for p in parts])
    counts = df.groupBy(*keys, label.alias("orbit_label")).agg(F.count(F.lit(1)).alias("scenes"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("scenes")).alias("n"), F.col("orbit_label"))).alias("_b")).select(
        *keys, F.col("_b.orbit_label").alias("orbit_label"), (-F.col("_b.n")).alias("scenes"))


def max_probability(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Greatest class probability over an interval, kept where it reaches the threshold."""
    return df.groupBy(*keys).agg(F.max(value).alias("probability"), F.count(value).alias("scenes")).filter(F.col("probability") >= threshold)
