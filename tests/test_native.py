"""Coarse cells in tiles: exact areas, complete and partial cells, image orientation."""

import math

import numpy as np
from pyspark.sql import functions as F

from landtally.functions import geo
from landtally.operators import native, pixels


def test_overlaps_sum_to_the_ring():
    axis = np.arange(41) * 30.0
    lattice = np.stack(np.meshgrid(axis, axis[::-1]), axis=-1)
    angle = math.radians(7)
    turned = lattice @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
    ring = np.array([[100.0, 110.0], [590.0, 95.0], [610.0, 600.0], [90.0, 580.0]]) + [-60, 200]
    areas = native.overlap_areas(ring, turned)
    assert math.isclose(areas.sum(), native.ring_area(ring), rel_tol=1e-12)
    grid = np.stack(np.meshgrid(np.arange(0, 1200, 2) + 1.0, 1200 - np.arange(0, 1200, 2) - 1.0), axis=-1) @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
    inside = np.ones(grid.shape[:2], bool)
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        inside &= native._cross(a, b, grid) >= 0
    counted = inside.reshape(40, 15, 40, 15).sum(axis=(1, 3)) * 4.0
    assert np.abs(areas - counted).max() < 60  # the rim of a pixel in steps of 2 m


def test_equal_area_keeps_areas_and_distances():
    lon, lat = np.meshgrid(np.array([8.99, 9.01]), np.array([44.99, 45.01]))
    p = native.equal_area(lon, lat, 9.0, 45.0)
    ring = np.array([p[0, 0], p[0, 1], p[1, 1], p[1, 0]])
    e2 = geo._E2
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    want = geo.WGS84_A ** 2 / 2 * (q(math.sin(math.radians(45.01))) - q(math.sin(math.radians(44.99)))) * math.radians(0.02)
    # The upper and lower sides are parallels, of which the ring has the chords.
    assert math.isclose(native.ring_area(ring), want, rel_tol=2e-6)
    east = native.equal_area(np.array([9.005]), np.array([45.0]), 9.0, 45.0)[0]
    assert abs(np.hypot(*east) - geo.vincenty_m([9.0], [45.0], [9.005], [45.0])[0]) < 1e-3


def test_complete_and_partial_cells(spark):
    """One tile, boxes of the geographic grid around its centre; rows count from the north as in K5."""
    lon, lat = 11.3, 47.2
    point = geo.with_projection(spark.createDataFrame([("a", lon, lat)], "sample_id string, lon double, lat double"))
    left, top = geo.snapped_corner(F.col("x"), F.col("y"))
    tile = point.select("sample_id", "lon", "lat", geo.grid_epsg(F.col("lon"), F.col("lat")).alias("epsg"), left.alias("left_m"), top.alias("top_m"))
    boxes = [(0, lon - 0.002, lat + 0.001, 0.004, 0.003), (1, lon - 0.002, lat - 0.004, 0.004, 0.003), (2, lon + 0.006, lat, 0.004, 0.003), (3, lon - 0.01, lat - 0.01, 0.02, 0.02)]
    cells = spark.createDataFrame([("a", *b) for b in boxes], "sample_id string, cell long, x double, y double, w double, h double")
    got = native.native_support(tile, cells.select("sample_id", "cell", native.cell_ring(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("ring")))
    rows = got.collect()
    assert {r.cell for r in rows} == {0, 1}  # one reaches over the edge, one holds the whole tile
    for cell, north in ((0, True), (1, False)):
        mine = [r for r in rows if r.cell == cell]
        assert math.isclose(sum(r.weight for r in mine), 1, rel_tol=1e-9)
        mean = sum(r.weight * r.out_row for r in mine)
        assert (mean < 19) == north and 19 < sum(r.weight * r.out_col for r in mine) < 21
        # 30 m pixels in a box of about 302 x 333 m, turned by the convergence.
        assert 120 < len(mine) < 180 and abs(max(r.weight for r in mine) - 900 / (302.9 * 333.5)) < 1e-4
        assert all((r.out_row - 1) * 3 <= r.centre_row + 45 and r.centre_row // 3 in {x.out_row for x in mine} for r in mine)
    # The image pixel that the centre names has the output pixel that K5 makes of it.
    image = spark.range(120 * 120).select(F.lit("a").alias("sample_id"), F.floor(F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col"))
    image = image.withColumn("value", (F.col("row") * 1000 + F.col("col")).cast("double")).withColumn("valid", F.col("row") < 60)
    targets = native.native_targets(got, image).select("cell", "value").distinct().collect()
    assert len(targets) == 1 and targets[0].cell == 0
    known = image.select("sample_id", "row", "col", F.lit(True).alias("known"), (F.col("row") < 60).cast("double").alias("water"), F.lit(0.0).alias("snow_ice"), F.lit(0.0).alias("land"))
    water = pixels.cover_targets(known, ["sample_id"]).select("out_row", "out_col", "water")
    share = got.join(water, ["out_row", "out_col"]).groupBy("cell").agg(F.sum(F.col("weight") * F.col("water")).alias("s")).collect()
    assert {r.cell: round(r.s, 9) for r in share} == {0: 1.0, 1: 0.0}


def test_sinusoidal_cells(spark):
    df = spark.createDataFrame([(7.0e5, 5.0e6, 463.3, 463.3)], "x double, y double, w double, h double")
    ring = df.select(native.cell_ring(F.col("x"), F.col("y"), F.col("w"), F.col("h"), sinusoidal=True).alias("r")).first().r
    p = native.equal_area(np.array([v.lon for v in ring]), np.array([v.lat for v in ring]), ring[0].lon, ring[0].lat)
    assert len(ring) == 64 and abs(native.ring_area(p) / 463.3 ** 2 - 1) < 0.01  # equal area on the sphere, within its flattening on the ellipsoid


def test_stations_of_one_place_are_worked_out_once(spark, monkeypatch):
    from types import SimpleNamespace

    from landtally.operators import native
    from landtally.plans import space

    rows = [("a", 11.31, 44.12), ("b", 11.31, 44.12), ("c", 12.77, 43.95), ("d", None, 44.0)]
    stations = spark.createDataFrame(rows, "location_id string, lon double, lat double")
    seen, plain = [], native.native_support
    monkeypatch.setattr(native, "native_support", lambda tiles, cells, *a: seen.append(tiles.count()) or plain(tiles, cells, *a))
    out = {}
    for r in space.j12(SimpleNamespace(stations=stations)).collect():
        out.setdefault(r.sample_id, set()).add(tuple(r)[1:])
    assert seen == [2] and set(out) == {"a", "b", "c"} and out["a"] == out["b"] != out["c"]
