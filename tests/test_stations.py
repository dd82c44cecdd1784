"""Footprint candidates of one station by hand, rematching, dated heights and injective identities."""

import hashlib
import json
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from landtally.functions import geo, keys as K
from landtally.operators import checks, footprint, stations
from landtally.sources import metadata

DAY = 86400
START = 1577836800  # 2020-01-01
STATE = dict(ws=1.5, h=800.0, ol=-20.0, sigmav=0.8, ustar=0.4)


def wind(i):
    return float(i * 37 % 360)


def tower(spark, station, days=32):
    flux = [(station, START + i * 1800, START + (i + 1) * 1800, 100.0, 0) for i in range(days * 48)]
    return spark.createDataFrame(flux, "station string, start_s long, end_s long, le double, qc int")


def params(spark, station, days=32, flag=lambda i: 0):
    rows = [(station, START + i * 1800, START + (i + 1) * 1800, *STATE.values(), wind(i), flag(i)) for i in range(days * 48)]
    return spark.createDataFrame(rows, "station string, start_s long, end_s long, ws double, h double, ol double, sigmav double, ustar double, wd double, provider_flag int")


def test_one_station_by_hand(spark):
    """Four windows: two on known heights, two after an ambiguous height. Other stations are not usable."""
    flux = tower(spark, "a").union(tower(spark, "b", 8)).union(tower(spark, "c", 8))
    # Every 48th flag is bad: 47 of 48 half hours of a day stay on the common support.
    p = params(spark, "a", flag=lambda i: 2 if i % 48 == 5 else 3 if i % 2 else 0).union(params(spark, "b", 8)).union(params(spark, "c", 8))
    heights = spark.createDataFrame([("a", START - 10 * DAY, 1, 6.2), ("a", START + 16 * DAY, 2, None), ("b", START, 3, None), ("c", START - DAY, 4, 6.0)], "station string, event_s long, event_id long, height double")
    canopy = spark.createDataFrame([("a", START - DAY, 1, 0.3), ("b", START - DAY, 2, 0.3), ("c", START - DAY, 3, 0.3)], "station string, event_s long, event_id long, canopy double")
    sites = spark.createDataFrame([("a", 11.5, 45.0, "g1", "train", 2), ("b", 10.0, 45.0, "g2", "train", 1), ("c", 10.0, 45.0, "g3", "unresolved", 1)],
                                  "station string, lon double, lat double, spatial_group_id string, split string, frequency_bin int")
    out = stations.footprint_candidates(flux, p, heights, canopy, sites, ["station"], ["spatial_group_id", "split", "frequency_bin"], version="v1",
                                        as_of="2021-01-01T00:00:00Z", steps=(10.0, 5.0), tolerance=0.02)
    rows = {r.target_time: r for r in out.candidates.collect()}
    assert sorted(rows) == [date(2020, 1, 1), date(2020, 1, 9)]
    r = rows[date(2020, 1, 9)]
    assert (r.station, r.spatial_group_id, r.split, r.frequency_bin, r.year, r.month, str(r.target_end)) == ("a", "g1", "train", 2, 2020, 1, "2020-01-17")
    assert r.candidate_id == hashlib.sha256(json.dumps(["v1", "a", "2020-01-09"]).encode()).hexdigest()[:24]
    assert abs(r.et - 100 * DAY / 2450000) < 1e-12 and r.intervals == 8 * 47 and r.interval_seconds == 8 * 47 * 1800
    # The same mass straight from the density, on the station's own turned and scaled grid.
    g = geo.with_grid_factors(sites.filter("station = 'a'")).first()
    assert g.convergence_deg > 1.7 and g.grid_scale > 0.9996
    east, north, area = footprint.tile_points(5.0, g.grid_scale, g.convergence_deg)
    use = [i for i in range(8 * 48, 16 * 48) if i % 48 != 5]
    mass = sum(footprint.density_array(east, north, dict(STATE, zm=6.0, wd=wind(i))) for i in use) * area / len(use)
    assert abs(r.captured_mass - mass.sum()) < 1e-9 and r.step_m == 5.0 and r.l1_difference < 0.02 and r.captured_mass - r.l1_difference >= 0.95
    cells = {c.cell: c.mass for c in out.mass.filter("target_time = '2020-01-09'").collect()}
    assert np.allclose([cells[k] for k in range(1600)], mass.reshape(40, 6, 40, 6).sum(axis=(1, 3)).ravel(), atol=1e-12)
    lost = {x.reason: x.n for x in out.rejections.collect()}
    assert lost == {f"common_{k}": 2 for k in ("effective_duration", "measured_duration", "day_coverage", "night_coverage", "missing_or_negative_window_et")}
    c = out.counts.collect()
    assert len(c) == 1 and (c[0].total, c[0].windows, c[0].temporal_valid, c[0].common_support_valid, c[0].footprint_tile_valid) == (1536, 4, 4, 2, 2)
    assert (c[0].unknown_or_nonpositive_zm, c[0].rejected_provider_flag, c[0].joint_parameter_valid) == (768, 32, 752)


def test_rematch(spark):
    window = ["station", "target_time"]
    rows = [("a", day, s, 1800.0, 6.0, *STATE.values(), float(s * 90), 0.9996, 0.0) for day in ("d1", "d2", "d3") for s in range(4)]
    df = spark.createDataFrame(rows, "station string, target_time string, start_s long, seconds double, zm double, ws double, h double, ol double, sigmav double, ustar double, wd double, grid_scale double, convergence_deg double")
    old, _ = footprint.window_mass(df.drop("start_s"), window, (10.0, 5.0))
    kept = spark.createDataFrame([("a", "d1", s) for s in range(4)] + [("a", "d2", s) for s in (0, 2)], "station string, target_time string, start_s long")
    cells, status = stations.rematch(df, kept, old, window, [*window, "start_s"], (10.0, 5.0), 0.05, 0.9)
    assert {r.target_time: r.status for r in status.collect()} == {"d1": "reused", "d2": "recomputed", "d3": "no_interval_left"}
    got = {(r.target_time, r.cell): (r.mass, r.source) for r in cells.collect()}
    before = {(r.target_time, r.cell): r.mass for r in old.collect()}
    assert len(got) == 3200 and all(got["d1", k] == (before["d1", k], "reused") for k in range(1600))
    east, north, area = footprint.tile_points(5.0, 0.9996, 0.0)
    mass = sum(footprint.density_array(east, north, dict(STATE, zm=6.0, wd=w)) for w in (0.0, 180.0)) * area / 2
    assert np.allclose([got["d2", k][0] for k in range(1600)], mass.reshape(40, 6, 40, 6).sum(axis=(1, 3)).ravel(), atol=1e-12)
    _, strict = stations.rematch(df, kept, old, window, [*window, "start_s"], (10.0, 5.0), 0.05, 0.999)
    assert {r.target_time: r.status for r in strict.collect()}["d2"] == "mass_or_quadrature"


def test_dated_heights(spark):
    groups = [
        dict(HEIGHTC="1", HEIGHTC_DATE="20210101", HEIGHTC_STATISTIC="Mean"), dict(HEIGHTC="2", HEIGHTC_DATE="20210101", HEIGHTC_STATISTIC="90th Percentile"),
        dict(HEIGHTC="99", HEIGHTC_DATE="20210101", HEIGHTC_STATISTIC="90th Percentile", HEIGHTC_SPP="species"),
        dict(HEIGHTC="98", HEIGHTC_DATE="20210101", HEIGHTC_STATISTIC="90th Percentile", HEIGHTC_VEG_STATUS="Dead"),
        dict(HEIGHTC="97", HEIGHTC_DATE="20210101", HEIGHTC_STATISTIC="Maximum"),
        dict(HEIGHTC="3", HEIGHTC_DATE_START="20210201", HEIGHTC_DATE_END="20210228", HEIGHTC_STATISTIC="Mean", HEIGHTC_VEG_STATUS="Alive"),
        dict(HEIGHTC="4", HEIGHTC_DATE="202104011230", HEIGHTC_STATISTIC="Mean"), dict(HEIGHTC="5", HEIGHTC_DATE="202104011230", HEIGHTC_STATISTIC="Mean"),
        dict(HEIGHTC="-9999", HEIGHTC_DATE="20210501", HEIGHTC_STATISTIC="Mean"), dict(HEIGHTC="6", HEIGHTC_DATE="202105", HEIGHTC_STATISTIC="Mean"),
        dict(HEIGHTC="-1", HEIGHTC_DATE="20210601", HEIGHTC_STATISTIC="Mean"), dict(HEIGHTC="tall", HEIGHTC_DATE="20210601", HEIGHTC_STATISTIC="Mean")]
    long = [("a", 1, metadata.CANOPY, k, n, v) for k, g in enumerate(groups) for n, v in g.items()] + [("a", 1, metadata.CANOPY, 20, "HEIGHTC", v) for v in "12"]
    long += [("a", 1, metadata.CANOPY, 20, "HEIGHTC_STATISTIC", "Mean"), ("a", 1, metadata.CANOPY, 20, "HEIGHTC_DATE", "20210101")]
    long += [("a", 1, metadata.INSTRUMENT, 30 + k, n, v) for k, g in enumerate(({"VARNAME": "USTAR", "DATE": "20200101", "HEIGHT": "3.5"}, {"VARNAME": "TA", "DATE": "20200101", "HEIGHT": "9"})) for n, v in ((f"VAR_INFO_{n}", v) for n, v in g.items())]
    raw = spark.createDataFrame(long, "site string, offset_h int, VARIABLE_GROUP string, GROUP_ID int, VARIABLE string, DATAVALUE string")
    rows = metadata.height_groups(raw, ["site"], metadata.CANOPY, "offset_h")
    seconds = lambda y, m, d, s=0: int((np.datetime64(f"{y}-{m:02}-{d:02}") - np.datetime64("1970-01-01")).astype(int)) * DAY + s - 3600
    got = {r.t_s: (r.value, r.ambiguous) for r in metadata.metadata_events(rows, ["site"]).collect()}
    assert got == {seconds(2021, 1, 1): (2.0, False), seconds(2021, 2, 28): (3.0, False), seconds(2021, 4, 1, 45000): (None, True)}
    assert {r.discarded: r["count"] for r in rows.filter("discarded is not null").groupBy("discarded").count().collect()} == {
        "missing_value_or_exact_date": 2, "invalid_height": 2, "repeated_variable": 1}
    mine = metadata.metadata_events(metadata.height_groups(raw, ["site"], metadata.INSTRUMENT, "offset_h"), ["site"]).collect()
    assert [(r.t_s, r.value) for r in mine] == [(seconds(2020, 1, 1), 3.5)]


def test_identities_are_json_and_injective(spark):
    texts = ["plain", 'quo"te', "back\\slash", "tab\tline\nfeed\r\b\f\x01\x1f", "é", "𝄞 music", "", None, "del\x7f", "a|b", "null"]
    rows = spark.createDataFrame([(i, t, t if i % 2 else None) for i, t in enumerate(texts)], "i int, t string, u string")
    got = rows.select("i", "t", "u", K.canonical_list(43, K.quoted(F.col("t")), F.col("i"), K.quoted(F.col("u"))).alias("c"), K.fingerprint(43, K.quoted(F.col("t"))).alias("h")).collect()
    for r in got:
        assert r.c == json.dumps([43, r.t, r.i, r.u]) and r.h == hashlib.sha256(json.dumps([43, r.t]).encode()).hexdigest()
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), (None, "a"), ("", "a")], "x string, y string")
    assert checks.row_fingerprints(pairs, ["x", "y"]).select("fingerprint").distinct().count() == 6
    assert {round(u.u, 9) for u in spark.range(1).select(K.hash_unit(F.lit("f" * 64)).alias("u"), K.hash_unit(F.lit("0" * 64)).alias("v")).collect()} == {1.0}
