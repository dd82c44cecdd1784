"""Composed station pipelines: footprint candidates, rematching and target assembly."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from landtally.functions import keys as K
from landtally.functions.geo import with_grid_factors
from landtally.operators import footprint, intervals as iv, ordered
from landtally.session import cut_lineage

# Zero-plane displacement as a share of the canopy's height, and the provider flags that leave the water flux usable.
DISPLACEMENT, USABLE_FLAGS = 2.0 / 3.0, (0, 3)


class Footprints(NamedTuple):
    """Candidates with lineage, rejection counts, interval counts per station, and the candidates' cell masses."""

    candidates: DataFrame
    rejections: DataFrame
    counts: DataFrame
    mass: DataFrame


def usable_sites(sites: DataFrame, heights: DataFrame, canopy: DataFrame, keys: list[str]) -> DataFrame:
    """Located sites of a known split and stratum with at least one unambiguous height of the instrument and of the canopy."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    if "frequency_bin" in sites.columns:
        ok = ok & (F.col("frequency_bin") >= 0)
    if "split" in sites.columns:
        ok = ok & (F.col("split") != "unresolved")
    known = lambda events, value: events.filter(F.col(value).isNotNull()).select(*keys)
    return sites.filter(ok).join(known(heights, "height"), keys, "left_semi").join(known(canopy, "canopy"), keys, "left_semi")


def _interval_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per station how many intervals meet each requirement; the rejections overlap."""
    finite = F.lit(True)
    for k in footprint.PARAMETERS:
        finite = finite & F.col(k).isNotNull() & ~F.isnan(k)
    measures = {
        "total": F.lit(True), "finite_parameters": finite, "physical_valid": F.col("_physical"), "provider_usable": F.col("_provider"),
        "joint_parameter_valid": F.col("support"), "unknown_canopy": F.col("canopy").isNull(), "unknown_or_nonpositive_zm": F.col("zm").isNull() | (F.col("zm") <= 0),
        "roughness_sublayer": F.col("zm") <= 12.5 * 0.15 * F.col("canopy"), "low_ustar": F.col("ustar") <= 0.1, "missing_boundary_layer": F.col("h").isNull(),
        "rejected_provider_flag": ~F.col("_provider")}
    return rows.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in measures.items()])


def footprint_candidates(flux: DataFrame, params: DataFrame, heights: DataFrame, canopy: DataFrame, sites: DataFrame, keys: list[str],
                         lineage: list[str] = (), version: str = "footprint", as_of: str | None = None, canopy_days: int = 366,
                         steps: tuple[float, ...] = (10.0, 5.0, 2.5), tolerance: float = 0.01, minimum: float = 0.95) -> Footprints:
    """Windows valid in time and on the common footprint support, with enough tile mass.

    ``sites`` gives lon, lat and the ``lineage`` columns of each station; stations that :func:`usable_sites` leaves out have no
    result. Flux rows keep their place when parameters are missing. Heights come from the last dated event;
    an ambiguous event (NULL) invalidates until the next one. The quadrature uses each station's own grid scale and
    convergence. Windows are those inside the station's record whose context has ended ``as_of``, windows without rows included.
    """
    chosen = cut_lineage(with_grid_factors(usable_sites(sites, heights, canopy, keys).select(*keys, "lon", "lat", *lineage)))
    place = chosen.select(*keys, "lon", "lat", "grid_scale", "convergence_deg")
    rows = flux.select(*keys, "start_s", "end_s", "le", "qc").join(place, keys)
    rows = rows.join(params, [*keys, "start_s", "end_s"], "left")
    rows = ordered.asof_backward(rows, heights, keys, "start_s", "event_s", ["height"], tie=["event_id"]).drop("event_s")
    rows = ordered.asof_backward(rows, canopy, keys, "start_s", "event_s", ["canopy"], tie=["event_id"], max_age=canopy_days * 86400).drop("event_s")
    rows = rows.withColumn("zm", F.col("height") - F.col("canopy") * DISPLACEMENT)
    rows = rows.withColumn("_physical", footprint.parameter_valid({k: F.col(k) for k in (*footprint.PARAMETERS, "canopy")}))
    rows = rows.withColumn("_provider", F.coalesce(F.col("provider_flag").isin(*USABLE_FLAGS), F.lit(False)))
    rows = cut_lineage(rows.withColumn("support", F.col("_physical") & F.col("_provider")))

    site = [*keys, "lat", "lon"]
    spine = cut_lineage(iv.window_spine(rows, site, whole=True, as_of=as_of))
    temporal = iv.interval_labels(rows, keys, spine=spine)
    common = iv.interval_labels(rows, keys, support=F.col("support"), spine=spine)
    window = [*keys, "target_time"]
    both = cut_lineage(temporal.select(*window, "target_end", F.col("value").alias("temporal_et"), F.col("valid").alias("_t"), F.col("reasons").alias("_tr")).join(
        common.select(*window, "value", "valid", "reasons"), window))
    good = both.filter("_t and valid").select(*window)
    inside = iv.touch_windows(rows.filter("support and le is not null and not isnan(le) and qc in (0, 1)")).filter("overlap_s > 0").join(good, window, "left_semi")
    inside = cut_lineage(inside.select(*window, F.col("overlap_s").cast("double").alias("seconds"), *footprint.PARAMETERS, "grid_scale", "convergence_deg"))
    mass, note = footprint.window_mass(inside, window, steps, tolerance, minimum)
    used = inside.groupBy(*window).agg(F.count(F.lit(1)).alias("intervals"), F.sum("seconds").alias("interval_seconds"))
    done = cut_lineage(both.filter("_t and valid").join(note, window).join(used, window))

    prefix = lambda p, c: F.transform(c, lambda r: F.concat(F.lit(p), r))
    why = F.when(~F.col("_t"), prefix("temporal_", F.col("_tr"))).otherwise(prefix("common_", F.col("reasons")))
    lost = both.filter("not (_t and valid)").select(*keys, F.explode(why).alias("reason"))
    heavy = done.filter("not accepted").select(*keys, F.lit("footprint_mass_or_quadrature").alias("reason"))
    rejections = lost.unionByName(heavy).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))

    identity = K.short_id(K.quoted(F.lit(version)), *[K.quoted(F.col(k)) for k in keys], K.quoted(F.date_format("target_time", "yyyy-MM-dd")))
    accepted = done.filter("accepted")
    candidates = accepted.join(chosen.select(*keys, "lon", "lat", *lineage), keys).select(
        identity.alias("candidate_id"), *keys, *lineage, "lon", "lat", "target_time", "target_end", F.year("target_time").alias("year"), F.month("target_time").alias("month"),
        F.col("value").alias("et"), "temporal_et", "captured_mass", "truncated_mass", "l1_difference", "step_m", "intervals", "interval_seconds")
    stages = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("_t"), 1)).alias("temporal_valid"),
                                     F.count(F.when(F.col("_t") & F.col("valid"), 1)).alias("common_support_valid"))
    ready = accepted.groupBy(*keys).agg(F.count(F.lit(1)).alias("footprint_tile_valid"))
    counts = _interval_counts(rows, keys).join(stages, keys, "left").join(ready, keys, "left").na.fill(
        0, ["windows", "temporal_valid", "common_support_valid", "footprint_tile_valid"])
    return Footprints(candidates, rejections, counts, mass.join(accepted.select(*window), window, "left_semi"))


def rematch(intervals: DataFrame, kept: DataFrame, mass: DataFrame, keys: list[str], interval_key: list[str],
            steps: tuple[float, ...] = (10.0, 5.0, 2.5), tolerance: float = 0.01, minimum: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Reuse a window's mass when all its intervals stay valid, recompute it from the retained ones otherwise.

    The recomputation refines its quadrature as the first one did. Returns the cell masses of accepted windows with their
    ``source``, and a status per window: ``reused``, ``recomputed``, ``mass_or_quadrature`` or ``no_interval_left``.
    """
    flagged = cut_lineage(intervals.join(kept.select(*interval_key).distinct().withColumn("_k", F.lit(1)), interval_key, "left"))
    state = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_kept"))
    whole = state.filter("_n = _kept").select(*keys)
    partial = state.filter("_n > _kept and _kept > 0").select(*keys)
    rest = flagged.filter("_k = 1").join(partial, keys, "left_semi").drop("_k", *[k for k in interval_key if k not in keys])
    again, note = footprint.window_mass(rest, keys, steps, tolerance, minimum)
    accepted = note.filter("accepted").select(*keys)
    cells = mass.join(whole, keys, "left_semi").withColumn("source", F.lit("reused")).unionByName(
        again.join(accepted, keys, "left_semi").withColumn("source", F.lit("recomputed")))
    status = whole.withColumn("status", F.lit("reused")).unionByName(
        note.select(*keys, F.when(F.col("accepted"), "recomputed").otherwise("mass_or_quadrature").alias("status"))).unionByName(
        state.filter("_kept = 0").select(*keys, F.lit("no_interval_left").alias("status")))
    return cells, status


def build_targets(cover: DataFrame, sm: DataFrame, tile: str, et: DataFrame | None = None) -> DataFrame:
    """Cover targets with the tile's soil-moisture value where eligible, and native ET cells if given."""
    s = sm.select(tile, F.col("value").alias("_v"), F.col("eligible").alias("_e"))
    ok = F.coalesce(F.col("_e"), F.lit(False))
    out = cover.join(s, tile, "left").withColumn("soil_moisture_valid", ok).withColumn("soil_moisture", F.when(ok, F.col("_v"))).drop("_v", "_e")
    return out if et is None else out.join(et, [tile, "out_row", "out_col"], "left")
