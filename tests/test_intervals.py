"""Window labels and ordered primitives against hand values and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from landtally.operators import intervals as iv, ordered

DAY = 86400
START = 1577836800  # 2020-01-01


def halves(spark, days, le=100.0, skip=lambda i: False):
    rows = [(1, 45.0, 7.0, START + i * 1800, START + (i + 1) * 1800, le, 0) for i in range(days * 48) if not skip(i)]
    return spark.createDataFrame(rows, "station int, lat double, lon double, start_s long, end_s long, le double, qc int")


def test_constant_flux(spark):
    r = iv.interval_labels(halves(spark, 8), ["station"]).collect()
    assert len(r) == 1 and r[0].valid and abs(r[0].value - 100 * DAY / 2450000) < 1e-12
    assert abs(r[0].valid_fraction - 1) < 1e-12


def test_missing_time_stays_in_the_denominator(spark):
    r = iv.interval_labels(halves(spark, 8, skip=lambda i: i % 4 == 0), ["station"]).collect()[0]
    assert abs(r.valid_fraction - 0.75) < 1e-12 and "effective_duration" in r.reasons
    assert abs(r.value - 100 * DAY / 2450000) < 1e-12


def test_windows_without_rows_are_rejected(spark):
    """Days 8 to 23 of a record of 32 days are missing; a second site has one hour."""
    both = halves(spark, 32, skip=lambda i: 8 <= i // 48 < 24).union(halves(spark, 1, skip=lambda i: i > 1).withColumn("station", F.lit(2)))
    out = {(r.station, str(r.target_time)): r for r in iv.interval_labels(both, ["station"]).collect()}
    assert sorted(out) == [(1, "2020-01-01"), (1, "2020-01-09"), (1, "2020-01-17"), (1, "2020-01-25"), (2, "2020-01-01")]
    for day in ("2020-01-09", "2020-01-17"):
        r = out[1, day]
        assert r.value is None and r.valid_fraction == 0 and r.reasons == ["effective_duration", "measured_duration", "day_coverage", "night_coverage", "missing_or_negative_window_et"]
    assert out[1, "2020-01-25"].valid and not out[2, "2020-01-01"].valid
    whole = iv.window_spine(both, ["station"], whole=True).collect()
    assert sorted((r.station, str(r.target_time)) for r in whole) == [(1, "2020-01-01"), (1, "2020-01-09"), (1, "2020-01-17"), (1, "2020-01-25")]
    late = iv.window_spine(both, ["station"], whole=True, as_of="2020-02-05T00:00:00Z")
    assert sorted(str(r.target_time) for r in late.collect()) == ["2020-01-01", "2020-01-09"]


def test_mornings_missing_from_a_window(spark):
    lon, t0 = 0.0, START + 6 * 3600
    rows = [(1, lon, t0 + d * DAY, 0.3, True) for d in (0, 1, 2, 3, 4, 5, 6, 7, 17)] + [(2, lon, t0, 0.3, False)]
    df = spark.createDataFrame(rows, "sensor int, lon double, t_s long, value double, good boolean").withColumn("until_s", F.col("t_s") + 1)
    out = iv.morning_means(iv.nearest_mornings(df, ["sensor"]), ["sensor"], spine=iv.window_spine(df, ["sensor", "lon"], "t_s", "until_s"))
    got = {(r.sensor, str(r.target_time)): (r.valid_days, r.expected_days, r.valid) for r in out.collect()}
    assert got == {(1, "2020-01-01"): (8, 8, True), (1, "2020-01-09"): (0, 8, False), (1, "2020-01-17"): (1, 8, False), (2, "2020-01-01"): (0, 8, False)}


def test_daily_support_is_inclusive(spark):
    for missing, kept in ((12, 36), (13, 0)):
        df = halves(spark, 1, skip=lambda i: i < missing)
        out = iv.daily_support(df, ["station"], F.col("le").isNotNull(), "kept")
        assert out.filter("kept").count() == kept


def test_midnight_split(spark):
    df = spark.createDataFrame([(1, START - 900, START + 900, 5.0)], "station int, start_s long, end_s long, le double")
    rows = sorted((r.start_s, r.end_s) for r in iv.split_at_midnight(df).collect())
    assert rows == [(START - 900, START), (START, START + 900)]


def test_closure_status(spark):
    base = dict(station=1, h=50.0, g=10.0, netrad=210.0, sw_in=100.0, h_qc=0, g_qc=0, le_qc=0, netrad_qc=0, sw_in_qc=0)
    rows = [dict(base, le=110.0, start_s=START + d * DAY, end_s=START + d * DAY + 1800) for d in (0, 366)]
    out = {r.mode: r for r in iv.energy_closure(spark.createDataFrame(rows), "station").collect()}
    assert abs(out["measured_all"].ebr - 160 / 200) < 1e-12 and out["measured_all"].status == "pass"
    assert out["measured_all"].monthly_intervals == {"2020-01": 1, "2021-01": 1}


def test_asof_null_event_invalidates(spark):
    events = spark.createDataFrame([("a", 10, 1, 5.0), ("a", 200000, 2, None), ("a", 500000, 3, 7.0)], "k string, e long, id int, v double")
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 199999), ("a", 400000), ("a", 900000), ("b", 50)], "k string, t long")
    out = {(r.k, r.t): r.v for r in ordered.asof_backward(left, events, ["k"], "t", "e", ["v"], tie=["id"], bucket=1000.0).collect()}
    assert out == {("a", 5): None, ("a", 10): 5.0, ("a", 199999): 5.0, ("a", 400000): None, ("a", 900000): 7.0, ("b", 50): None}


def test_exact_percentiles_bracketed(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0, 1), 3)) for _ in range(4000)] + [("cold", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {(r.g, r.p): r.percentile for r in ordered.exact_percentiles(df, ["g"], "v", [0.5, 0.95], accuracy=100, most=20, parts=4).collect()}
    for g in ("hot", "cold"):
        v = [x for k, x in rows if k == g]
        for p in (0.5, 0.95):
            assert abs(out[(g, p)] - np.quantile(v, p)) < 1e-9


def test_exact_percentiles_of_every_size_and_shape(spark):
    """Ties at an edge, few rows, NULL groups and values, heavy tails; several rounds of narrowing."""
    rng = random.Random(4)
    shapes = {"ties": [5.0] * 900 + [1.0, 2.0, 9.0], "one": [3.5], "two": [1.0, 2.0], "tail": [10.0 ** rng.uniform(-200, 200) for _ in range(1500)],
              "whole": [float(rng.randrange(40)) for _ in range(1200)], None: [float(k) for k in range(37)], "late": [0.0] + [7.0] * 500}
    rows = [(g, v) for g, vs in shapes.items() for v in [*vs, None]] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    for most in (2, 4096):
        out = {(r.g, r.p): (r.n, r.percentile) for r in ordered.exact_percentiles(df, ["g"], "v", ps, accuracy=50, most=most, parts=4).collect()}
        assert len(out) == 5 * len(shapes)
        for g, vs in shapes.items():
            for p in ps:
                want = float(np.quantile(np.array(vs), p))
                assert out[g, p][0] == len(vs) and abs(out[g, p][1] - want) <= 1e-12 * abs(want), (g, p)
    everything = [v for vs in shapes.values() for v in vs]
    whole = ordered.exact_percentiles(df, [], "v", [0.5]).collect()
    assert [(r.n, r.percentile) for r in whole] == [(len(everything), float(np.quantile(everything, 0.5)))]
    assert ordered.exact_percentiles(df.limit(0), ["g"], "v", ps).count() == 0


def test_numbered_matches_row_number_in_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 50 == 0).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = ordered.numbered_by_hash(df, ["g"], "h", "rn").collect()
    for g in (True, False):
        mine = sorted((r.h, r.rn) for r in rows if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_merged_spans_across_buckets(spark):
    rng = random.Random(1)
    spans = [(1, s, s + rng.randint(1, 400)) for s in (rng.randint(0, 20000) for _ in range(120))]
    df = spark.createDataFrame(spans, "k int, a long, b long")
    got = sorted((r.a, r.b) for r in iv.merged_spans(df, ["k"], "a", "b", bucket_s=1000).collect())
    want = []
    for _, a, b in sorted(spans):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    assert got == want
