"""Metrics, bootstraps and footprint masses on small hand-checked inputs."""

import numpy as np
from pyspark.sql import functions as F

from landtally.operators import footprint, metrics, spatial


def test_complete_pure_cells_or_a_reason(spark):
    rows = [("ok", .25, 2.0, .96), ("ok", .75, 6.0, 1.0), ("null", .25, None, .96), ("null", .75, 6.0, 1.0),
            ("zero", .25, 0.0, .96), ("zero", .75, 6.0, 1.0), ("impure", .25, 2.0, .95), ("impure", .75, 6.0, 1.0), ("part", .75, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, weight double, et double, purity double")
    got = {r.k: (r.value, r.reason) for r in spatial.reduce_cells(df, ["k"]).collect()}
    assert got["ok"] == (5.0, None) and got["zero"] == (4.5, None)
    assert got["null"][0] is None and got["impure"] == (None, "impure_cell") and got["part"] == (None, "incomplete_weight")


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "t int, p int")
    got = {r.cls: r for r in metrics.class_metrics(metrics.confusion(df, [], "t", "p"), [], "t", "p").collect()}
    assert got[0].f1 == 1.0 and got[1].precision is None and got[1].recall == 0.0 and got[2].precision == 0.5
    s = metrics.class_summary(metrics.class_metrics(metrics.confusion(df, [], "t", "p"), [], "t", "p"), []).collect()[0]
    assert abs(s.accuracy - 2 / 3) < 1e-12 and s.macro_f1_defined_classes == 3


def test_between_and_within_have_opposite_signs(spark):
    rows = []
    for s in range(3):
        for w in range(3):
            rows.append((f"site{s}", f"st{s}", f"2020-01-0{w + 1}", "dynamic", 10.0 * s - w, 10.0 * s + w))
    df = spark.createDataFrame(rows, "site string, station string, date string, mode string, pred double, target double")
    got = {r.metric: r.value for r in metrics.station_skill(df, "mode", 20, 1).collect()}
    assert abs(got["between_r"] - 1) < 1e-9 and abs(got["within_r"] + 1) < 1e-9


def test_resamples_draw_every_group_count(spark):
    df = spark.range(7).select(F.concat(F.lit("g"), "id").alias("g"))
    rows = metrics.group_draws(df, "g", 30, 5).collect()
    per = {}
    for r in rows:
        per[r.draw] = per.get(r.draw, 0) + r.weight
    assert set(per) == set(range(31)) and set(per.values()) == {7}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, metrics.group_draws(df.repartition(5), "g", 30, 5).collect()))


def test_window_mass_equals_direct_sum(spark):
    p = [dict(zm=3.0, ws=2.0, h=900.0, ol=-40.0, sigmav=0.6, ustar=0.4, wd=float(w), seconds=s) for w, s in ((10, 1800.0), (190, 900.0), (300, 1800.0))]
    df = spark.createDataFrame([dict(x, station="a", grid_scale=0.9996, convergence_deg=1.0) for x in p])
    cells, note = footprint.window_mass(df, ["station"], steps=(10.0, 5.0))
    east, north, area = footprint.tile_points(5.0, 0.9996, 1.0)
    want = sum(footprint.density_array(east, north, x) * x["seconds"] for x in p) * area / sum(x["seconds"] for x in p)
    r = note.collect()[0]
    assert abs(r.captured_mass - want.sum()) < 1e-9 and 0.5 < r.captured_mass <= 1.01
    got = np.zeros(1600)
    for c in cells.collect():
        got[c.cell] = c.mass
    n = east.shape[0] // 40
    assert np.allclose(got, want.reshape(40, n, 40, n).sum(axis=(1, 3)).ravel(), atol=1e-12)


def test_equal_intervals_are_worked_out_once(monkeypatch):
    """Three windows of one grid and the same two parameter sets: as many evaluations as one window needs."""
    import pandas as pd

    states = [dict(grid_scale=0.9996, convergence_deg=1.0, zm=3.0, ws=2.0, h=900.0, ol=-40.0, sigmav=0.6, ustar=0.4, wd=w) for w in (10.0, 190.0)]
    rows = pd.DataFrame([dict(x, station=s, seconds=900.0 * (1 + i)) for x in states for i, s in enumerate("abc")])
    calls, plain = [], footprint.density_array
    monkeypatch.setattr(footprint, "density_array", lambda *a: calls.append(1) or plain(*a))
    one = pd.concat(footprint._partial_mass(["station"], 10.0)(iter([rows[rows.station == "a"]])))
    alone, got = len(calls), pd.concat(footprint._partial_mass(["station"], 10.0)(iter([rows]))).set_index("station")
    assert len(calls) == 2 * alone
    for i, s in enumerate("abc"):
        assert got.seconds[s] == 1800.0 * (1 + i) and np.allclose(got.mass[s], np.array(one.mass[0]) * (1 + i), rtol=1e-12)
