"""Hand-computed values of the column functions."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from landtally.functions import bins, calendar as cal, geo, keys as K, radiometry as rad
from landtally.operators import footprint, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_frequency_bins(spark):
    values = [0.0, 0.1, 19.0, 20.0, 40.0, 60.0, 80.0, 99.0, 100.0, float("nan"), None, -1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.select("i", bins.frequency_bin(F.col("v")).alias("a"), bins.frequency_bin_upper(F.col("v")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [0, 1, 1, 2, 3, 4, 5, 5, 6, None, None, None]
    assert rows[3].b == 1


def test_hash_percent_of_block(spark):
    assert one(spark, K.hash_percent(K.fingerprint(42, K.quoted(F.lit("36:13"))))) == 20


def test_calendar_windows(spark):
    rows = cal.calendar_windows(spark, "2020-12-25", "2021-01-01", as_of="2021-02-01").collect()
    assert [(r.target_time, r.target_end) for r in rows] == [(dt.date(2020, 12, 26), dt.date(2021, 1, 1))]
    assert cal.calendar_windows(spark, "2020-12-25", "2021-01-01", as_of="2021-01-10").count() == 0


def test_context_slots_start_sixteen_days_before(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")
    rows = cal.context_slots(df, F.col("d")).orderBy("slot").collect()
    assert len(rows) == 5 and rows[0].slot_start == dt.date(2019, 12, 16)


def test_class_rules(spark):
    p = F.array(*[F.lit(x) for x in (0.05, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.05)])
    state = rad.cover_state(p)
    assert one(spark, state["land"]) and not one(spark, state["water"])
    tie = F.array(*[F.lit(x) for x in (0.4, 0.4, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    assert one(spark, rad.argmax_class(tie)) == 0


def test_mercator_round_trip_and_scale(spark):
    df = spark.createDataFrame([(9.0, 45.0), (-70.3, -33.4), (12.49, 60.1)], "lon double, lat double")
    out = geo.with_mercator(df, F.col("lon"), F.col("lat"), "x", "y").withColumn("z", geo.utm_zone(F.col("lon")))
    lon, lat = geo.inverse_mercator(F.col("x"), F.col("y"), F.col("z"), F.col("lat") < 0)
    rows = out.withColumn("lon2", lon).withColumn("lat2", lat).collect()
    for r in rows:
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    # On the central meridian easting is the false easting.
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y - 4982950.400) < 0.01


def test_every_grid_round_trip(spark):
    places = [(9.0, 45.0), (-70.3, -33.4), (-45.0, 84.0), (135.0, 88.5), (-170.0, 85.2), (0.0, -80.5), (100.0, -89.9), (-60.0, -85.0), (179.9, 83.99)]
    df = geo.with_projection(spark.createDataFrame(places, "lon double, lat double"))
    lon, lat = geo.inverse_projection(F.col("x"), F.col("y"), geo.grid_epsg(F.col("lon"), F.col("lat")))
    for r in df.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert abs((r.lon - r.lon2 + 180) % 360 - 180) < 1e-8 and abs(r.lat - r.lat2) < 1e-9, r
    # A tile's half diagonal is 870 m, whatever its grid; polar grids shrink it by their scale only.
    circles = spatial.tile_circle(spark.createDataFrame(places, "lon double, lat double")).collect()
    assert all(840 < r.radius_m < 900 for r in circles)


def test_geodesic_of_one_degree_at_equator():
    d = geo.vincenty_m([0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 1.0])
    assert np.allclose(d, [111319.491, 110574.389], atol=0.01)


def test_coarse_circle(spark):
    df = spark.createDataFrame([(2250, 1062)], "col int, row int")
    r = spatial.coarse_circle(df, 0.08).collect()[0]
    assert abs(r.lon - 0.04) < 1e-9 and abs(r.lat) < 1e-6 and abs(r.radius_m - 16502) < 1e-6


def test_density_column_equals_array(spark):
    p = dict(zm=3.0, ws=2.5, h=800.0, ol=-40.0, sigmav=0.6, ustar=0.4, wd=35.0)
    df = spark.createDataFrame([p])
    c = {k: F.col(k) for k in p}
    for e, n in ((20.0, 30.0), (-10.0, 5.0)):
        v = df.select(footprint.density(F.lit(e), F.lit(n), c).alias("v")).collect()[0].v
        w = footprint.density_array(np.array([e]), np.array([n]), p)[0]
        assert math.isclose(v, w, rel_tol=1e-12, abs_tol=1e-18)


def test_grid_factors_are_the_derivative_of_the_projection(spark):
    """A metre north on the ellipsoid, projected: its direction and length in the grid."""
    places = [(9.0, 45.0), (11.9, 45.0), (6.2, -33.0), (0.1, 83.9), (179.5, 0.001), (-179.9, -79.0), (-45.0, 85.0), (20.0, 88.0), (100.0, -85.0), (-170.0, -89.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(places)], "i int, lon double, lat double")
    both = geo.with_projection(df).join(geo.with_projection(df.withColumn("lat", F.col("lat") + 1e-5), x="x1", y="y1").drop("lon", "lat"), "i")
    rows = geo.with_grid_factors(both).collect()
    for r in rows:
        phi = math.radians(r.lat + 0.5e-5)
        metres = math.radians(1e-5) * geo.WGS84_A * (1 - geo._E2) / (1 - geo._E2 * math.sin(phi) ** 2) ** 1.5
        dx, dy = r.x1 - r.x, r.y1 - r.y
        assert abs(math.hypot(dx, dy) / metres - r.grid_scale) < 2e-6
        turn = math.degrees(-math.atan2(dx, dy))  # grid north lies clockwise of true north where north leans to the west of the grid
        assert abs((turn - r.convergence_deg + 180) % 360 - 180) < 1e-3, (r.lon, r.lat, turn, r.convergence_deg)
    on_axis = [r for r in rows if r.i == 0][0]
    assert abs(on_axis.convergence_deg) < 1e-12 and abs(on_axis.grid_scale - 0.9996) < 1e-9


def test_density_at_published_values(spark):
    """Unnormalised densities of the published code for one state at four places."""
    p = dict(zm=10.0, ws=3.0, h=1000.0, ol=-100.0, sigmav=0.8, ustar=0.4, wd=35.0)
    got = footprint.density_array(np.array([100.0, 150.0, 300.0, 300.0]), np.array([150.0, 50.0, 0.0, 200.0]), p) * footprint.FFP_INTEGRAL
    assert np.allclose(got, [1.170607369043935e-5, 3.211858445900956e-7, 3.776245632193192e-15, 1.135044602795495e-7], rtol=1e-9, atol=1e-22)
