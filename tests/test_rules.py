"""Rules with hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from landtally.operators import joins, pixels, spatial, splits


def test_tiles_that_meet_share_a_group(spark):
    # 1,720 m apart on a meridian: more than either radius reaches alone, less than both radii together.
    step = 1720 / 111_132.0
    rows = [(1, "a", 9.0, 45.0), (2, "b", 9.0, 45.0 + step), (3, "c", 9.0, 45.2), (4, "d", 9.0, 45.2)]
    stations = spark.createDataFrame(rows, "location_id long, group_id string, lon double, lat double")
    radii = [r.radius_m for r in spatial.tile_circle(stations).collect()]
    assert min(radii) > 860 and max(radii) < 890
    products = spark.createDataFrame([], "product_id string, lon double, lat double, radius_m double")
    out = {r.location_id: r for r in splits.assign_splits(stations, products).collect()}
    assert out[1].spatial_group_id == out[2].spatial_group_id and out[1].split == out[2].split
    assert out[3].spatial_group_id == out[4].spatial_group_id != out[1].spatial_group_id
    assert out[1].physical_group_id != out[2].physical_group_id


def test_products_are_counted_without_listing_their_pairs_with_stations(spark, monkeypatch):
    # 40 stations on two places; products 0 to 29 on one circle, 30 on two circles of one place, 31 on circles of both, one without id.
    stations = spark.createDataFrame([(k, f"g{k}", 10.0 if k < 30 else 40.0, 50.0) for k in range(40)], "location_id long, group_id string, lon double, lat double")
    rows = [(p, 10.0, 50.0, 900.0) for p in range(30)] + [(30, 10.0, 50.0, 900.0), (30, 10.001, 50.0, 900.0), (31, 10.0, 50.0, 900.0), (31, 40.0, 50.0, 900.0),
                                                         (None, 40.0, 50.0, 900.0), (32, None, None, 900.0), (33, -60.0, 0.0, 900.0)]
    products = spark.createDataFrame(rows + rows[:3], "product_id long, lon double, lat double, radius_m double")
    plain, listed = splits.spatial.circles_overlap, []

    def counted(*args, **names):
        out = plain(*args, **names)
        listed.append(out.count())
        return out
    monkeypatch.setattr(splits.spatial, "circles_overlap", counted)
    out = {r.location_id: r for r in splits.assign_splits(stations, products).collect()}
    assert [out[k].product_overlap_count for k in (0, 29, 30, 39)] == [32, 32, 1, 1]
    assert {r.split for r in out.values()} == {"train"}
    assert max(listed) <= 4
    assert {r.product_id for r in splits.product_hits(stations, products).collect()} == {*range(32), None}


def test_hann_weights(spark):
    got = [r[0] for r in spark.range(8).orderBy("id").select(pixels.hann(F.col("id"), 8)).collect()]
    assert got == pytest.approx([math.sin(math.pi * (k + 1) / 9) ** 2 for k in range(8)])
    assert got[:4] == pytest.approx([0.117, 0.413, 0.750, 0.970], abs=5e-4)


def test_excluded_nan_stays_out_of_the_mean(spark):
    rows = [(1, True, True, 0.0, 0.0, 0.2), (1, True, True, 1.0, 0.0, float("nan")), (2, False, True, 0.0, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "tile int, known boolean, domain boolean, water double, snow_ice double, value double")
    out = {r.tile: r.value for r in pixels.land_weighted_mean(df, ["tile"]).collect()}
    assert out == {1: 0.2, 2: None}


def test_product_quality_goes_before_missing_mornings(spark):
    station = spark.createDataFrame([(1, 0.2), (2, 0.3)], "day int, station_value double")
    product = spark.createDataFrame([(1, 0.2, None), (2, 0.3, 0), (3, 0.1, 4), (4, 0.1, 0)], "day int, product_value double, qa int")
    got = {r.day: r.reason for r in joins.pair_days(station, product, ["day"]).collect()}
    assert got == {1: "product_quality", 2: None, 3: "product_quality", 4: "no_station_morning"}


def test_private_folders_are_refused_on_a_cluster():
    from types import SimpleNamespace

    from landtally.session import _private_folder

    with pytest.raises(RuntimeError):
        _private_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077")), "x")
    assert _private_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="local[2]")), "x")


def test_unknown_strata_are_drawn(spark):
    from landtally.operators.draws import STRATA, balanced_draw

    rows = [(k, 0, k % 5) for k in range(10)]
    df = spark.createDataFrame(rows, "candidate_id long, frequency_bin int, physical_group_id long")
    for k, name in enumerate(STRATA):
        df = df.withColumn(name, F.when((F.col("candidate_id") % 2 == 0) | F.lit(k > 0), F.lit(1)))
    assert balanced_draw(df, 43, 10).count() == 10


def test_tags_of_a_place_without_its_pairs(spark):
    """Equal to the pairs written out, and one hit per kind of window and sample instead of one per pair."""
    days = lambda df, cols: df.withColumns({c: F.date_add(F.lit("2020-01-01").cast("date"), F.col("d") + n) for c, n in cols.items()}).drop("d")
    w = days(spark.range(60).select(F.col("id").alias("window_id"), (F.col("id") % 2).alias("place"), (F.col("id") % 4 * 9).cast("int").alias("d")), dict(input_start=-16, input_end=24, target_time=0, target_end=8))
    s = days(spark.range(90).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("place"), (F.col("id") % 5 * 11).cast("int").alias("d")), dict(train_input_start=-16, train_input_end=24, train_target=0, train_target_end=8))
    want = joins.overlap_tags(w.drop("place"), s.drop("place"), w.select("window_id", "place").join(s.select("sample_id", "place"), "place").drop("place"))
    got = joins.overlap_tags_by_place(w, s, "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60
    assert joins.overlap_tags_by_place(w.union(w.withColumn("window_id", F.col("window_id") + 60)), s, "place").count() == 120
