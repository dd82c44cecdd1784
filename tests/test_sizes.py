"""Steps whose cost must not grow with copies, hot groups or rows that cannot be taken."""

import random

from pyspark.sql import Window, functions as F

from landtally.functions import keys as K
from landtally.operators import draws, ordered, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_boxes_are_compared_once(spark):
    """Two hundred copies of a box on either side, which no cell compares pair by pair, and the pairs of all others."""
    rng = random.Random(3)
    box = lambda i: (i, *(lambda x, y: (x, y, x + rng.choice((5.0, 30.0, 70.0)), y + 20.0))(rng.uniform(0, 200), rng.uniform(0, 200)))
    a, b = [box(i) for i in range(60)] + [(1000 + i, 10.0, 10.0, 40.0, 40.0) for i in range(700)], [box(i) for i in range(50)] + [(2000 + i, 20.0, 20.0, 50.0, 50.0) for i in range(30)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, x0 double, y0 double, x1 double, y1 double")
    out = spatial.boxes_intersect(frame(a, "l"), frame(b, "r"), 32.0, "l", "r")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    assert sorted(map(tuple, out.collect())) == want
    assert "_lids" in plan_of(out) and "_rids" in plan_of(out)


def test_percentiles_do_not_shuffle_rows_by_group(spark, monkeypatch):
    """A hot group is never dealt whole to one task, whether the edges are few or many."""
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 3000).cast("double").alias("v"))
    want = {r.g: r.p for r in rows.groupBy("g").agg(F.percentile("v", 0.5).alias("p")).collect()}
    seen = ordered._beside(rows.withColumnRenamed("v", "_v"), rows.select("g").distinct().withColumn("_edges", F.lit(1)), ["g"], ["_edges"])
    assert "SortMergeJoin" not in plan_of(seen) and seen.count() == 3000
    for small in (4096, 0):
        monkeypatch.setattr(ordered, "SMALL", small)
        assert {r.g: r.percentile for r in ordered.exact_percentiles(rows, ["g"], "v", [0.5], most=50).collect()} == want


def test_first_by_hash_ranks_the_cut_only(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 30, None).otherwise(F.col("id") % 3).alias("g"), "id", K.hash_rank(7, F.col("id").cast("string")).alias("h"))
    got = draws.equal_bin_head_by_hash(rows.withColumnRenamed("g", "b"), "b", "h")
    all_ = {}
    for r in rows.collect():
        all_.setdefault(r.g, []).append((r.h, r.id))
    assert sorted((r.b is None, r.b or 0, r.id) for r in got.collect()) == sorted((g is None, g or 0, i) for g, v in all_.items() for _, i in sorted(v)[:30])
    five = ordered.first_by_hash(rows, ["g"], "h", F.lit(5))
    assert sorted((r.g is None, r.g or 0, r.id) for r in five.collect()) == sorted((g is None, g or 0, i) for g, v in all_.items() for _, i in sorted(v)[:5])


def test_rows_of_no_drawn_bucket_are_not_ordered(spark, monkeypatch):
    """Twenty draws of 3,000 rows: only the rows of the buckets they fall in are put in order."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5).cast("double").alias("w"))
    seen, plain = [], draws.running_before
    monkeypatch.setattr(draws, "running_before", lambda df, groups, *a: (seen.append(df.count()) if "k" in df.columns else None) or plain(df, groups, *a))
    out = {r.draw: r.k for r in draws.weighted_draws(rows, "k", "w", 20, 9).collect()}
    assert len(out) == 20 and sum(seen) < 200
    ordered_rows = rows.filter("w > 0").withColumn("h", K.hash_rank(9, K.quoted(F.col("k")))).orderBy("h").collect()
    units = spark.range(1, 21).select("id", K.hash_unit(K.fingerprint(9, K.quoted(F.lit("draw")), F.col("id"))).alias("u")).collect()
    total = sum(r.w for r in ordered_rows)
    for u in units:
        end = 0.0
        for r in ordered_rows:
            end += r.w
            if u.u * total <= end:
                break
        assert out[u.id] == r.k


def test_conflict_free_leaves_rows_without_place(spark):
    """A row without place or day ends the rounds too, and copies of a place and day do not take part."""
    rows = [(i, f"{i * 37 % 101:03d}", 10.0, 20.0, i % 2) for i in range(100)] + [(200, "000", None, 1.0, 0), (201, "001", 9.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, rank string, x double, y double, d int").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d") * 60))
    first = [min((r for r in rows[:100] if r[4] == k), key=lambda r: r[1])[0] for k in (0, 1)]
    assert sorted(r.id for r in draws.conflict_free(df, "id", "rank", "x", "y", "day", max_dates=4).collect()) == sorted(first)


def _candidates(spark):
    rows = spark.range(400).select(F.concat(F.lit("c"), "id").alias("candidate_id"), (F.col("id") % 2).cast("int").alias("frequency_bin"), F.concat(F.lit("s"), F.col("id") % 10).alias("physical_group_id"),
                                   (F.col("id") % 3).cast("int").alias("landcover"), F.lit(1).alias("climate_class"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 37 % 90 * 8).cast("int")).alias("target_time"))
    return rows.withColumns({"year": F.year("target_time"), "month": F.month("target_time")})


def test_candidates_are_kept_once_for_all_rounds(spark, monkeypatch):
    """Every round reads the same table; where the successes fill every bin, none is written."""
    names, plain = [], draws.written
    monkeypatch.setattr(draws, "written", lambda df, name: names.append(name) or plain(df, name))
    c, quotas = _candidates(spark), spark.createDataFrame([(0, 12), (1, 9)], "frequency_bin int, quota long")
    assert draws.stratified_pick(c, quotas, 7, 40).count() == 21 and names.count("pool") == 1
    names.clear()
    attempts = c.select("candidate_id", F.lit(True).alias("success"))
    out = draws.refill_plan(c, attempts, quotas, 7, 40)
    assert out.count() == 0 and names == [] and out.columns == draws.stratified_pick(c, quotas, 7, 40).columns


def test_capacity_draw_writes_narrow_tables(spark, monkeypatch):
    """Between the levels only ids, strata, dates and visits are written; ranks number each bin and capacities are met."""
    tables, plain = [], draws.written
    monkeypatch.setattr(draws, "written", lambda df, name: tables.append(df.columns) or plain(df, name))
    c = _candidates(spark).withColumn("physical_group_id", F.concat("physical_group_id", F.lit("-"), "frequency_bin"))
    out = draws.capacity_draw(c, 43)
    got = {r.physical_group_id: r.n for r in out.groupBy("physical_group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {r.physical_group_id: r.capacity for r in draws.spaced_capacity(c, ["physical_group_id"], "target_time").collect()}
    assert len(tables) == 5 and not any({"_hash", "_child"} & set(t) for t in tables) and out.columns == [*c.columns, "draw_rank"]
    ranks = draws.picker_positions(c, 43, "n").groupBy("frequency_bin").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.count(F.lit(1))).collect()
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in ranks)


def _chained(c, seed):
    """Positions of the rotation by rankings of all rows, level by level."""
    paths = [["frequency_bin", "landcover", "climate_class", "year", "month", "physical_group_id"][:k] for k in (6, 5, 4, 3, 1)]
    out = c.withColumn("v", F.row_number().over(Window.partitionBy(*paths[0]).orderBy(K.hash_rank(seed, K.quoted(F.col("candidate_id"))))))
    for child, parent in zip(paths, paths[1:]):
        out = out.withColumn("h", K.hash_rank(seed, K.canonical_list(*[F.col(k) for k in child])))
        out = out.withColumn("v", F.row_number().over(Window.partitionBy(*parent).orderBy("v", "h")))
    return {r.candidate_id: r.v for r in out.collect()}


def _uneven_candidates(spark):
    """Sites and months of one row to many, with NULL strata and a NULL site."""
    c = spark.range(900).select(F.concat(F.lit("c"), "id").alias("candidate_id"), F.when(F.col("id") < 350, 1).otherwise(F.col("id") % 3).cast("int").alias("frequency_bin"),
                                F.when(F.col("id") < 300, "hot").when(F.col("id") % 23 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") * 31 % 47)).alias("physical_group_id"),
                                F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("int").alias("landcover"), (F.col("id") * 13 % 4).cast("int").alias("climate_class"),
                                F.date_add(F.lit("2020-01-01").cast("date"), (F.pow("id", 2) % 97 * 9).cast("int")).alias("target_time"))
    return c.withColumns({"year": F.when(F.year("target_time") < 2022, F.year("target_time")), "month": F.when(F.month("target_time") < 12, F.month("target_time"))})


def test_rotation_follows_from_counts(spark, monkeypatch):
    """Positions equal chained rankings of all rows, though no table of candidates is written, whether sites and months are small, cut by hash or cut by visits."""
    c, tables, plain = _uneven_candidates(spark).cache(), [], draws.written
    monkeypatch.setattr(draws, "written", lambda df, name: tables.append(df.columns) or plain(df, name))
    want = _chained(c, 43)
    for visits, rows, placed in ((1024, 1 << 20, 1 << 18), (1024, 1 << 20, 7), (4, 1 << 20, 1 << 18), (3, 250, 5)):
        monkeypatch.setattr(draws, "VISITS", visits), monkeypatch.setattr(draws, "STATION_ROWS", rows), monkeypatch.setattr(draws, "PLACED", placed)
        got = draws.picker_positions(c, 43, "n").select("candidate_id", "n").collect()
        assert len(got) == len(want) and {r.candidate_id: r.n for r in got} == want
    assert tables and not any("candidate_id" in t for t in tables)


def test_capacity_picks_are_the_draw(spark):
    """The picks come out of the shuffle by station with the draw's ids and ranks, without a join with the candidates."""
    c = _candidates(spark).withColumn("physical_group_id", F.concat("physical_group_id", F.lit("-"), "frequency_bin"))
    picks = draws.capacity_picks(c, 43)
    names = ["frequency_bin", "physical_group_id", "target_time", "candidate_id", "draw_rank"]
    assert sorted(map(tuple, picks.select(names).collect())) == sorted(map(tuple, draws.capacity_draw(c, 43).select(names).collect()))
    assert "Join" not in plan_of(picks).split("repartition", 1)[0].split("REPARTITION_BY_NUM", 1)[0]


def test_station_step_equals_the_check_of_each_date(spark):
    """Dates that keep the largest schedule possible, asked one by one, with equal ranks of words and numbers, timestamps and no gap."""
    import datetime as dt
    rng = random.Random(4)

    def count(days, gap):
        n, last = 0, None
        for d in sorted(days):
            if last is None or d - last >= gap:
                n, last = n + 1, d
        return n

    base, rows, want = dt.date(2020, 1, 1), [], {}
    for s in range(40):
        days = rng.sample(range(200), rng.choice((1, 2, 12, 40)))
        ranks = rng.sample(range(10, 99), len(days))
        rows += [(f"s{s}", base + dt.timedelta(days=d), r, str(r), f"s{s}-{d}") for d, r in zip(days, ranks)]
        for gap, full in ((30, True), (30, False), (1, True), (0, True)):
            chosen, free = [], list(days)
            for r, d in sorted(zip(ranks, days)):
                if all(abs(d - k) >= gap for k in chosen):
                    rest = [k for k in free if abs(k - d) >= gap]
                    if not full or len(chosen) + 1 + count(rest, gap) >= count(days, gap):
                        chosen, free = [*chosen, d], rest
            want.setdefault((gap, full), set()).update(f"s{s}-{d}" for d in chosen)
    df = spark.createDataFrame(rows, "physical_group_id string, target_time date, n long, word string, candidate_id string")
    for (gap, full), ids in want.items():
        for rank in ("n", "word"):
            assert {r.candidate_id for r in draws.spaced_picks(df, ["physical_group_id"], rank, gap, full=full).collect()} == ids
    timed = df.withColumn("target_time", F.col("target_time").cast("timestamp") + F.expr("INTERVAL 5 HOURS"))
    assert {r.candidate_id for r in draws.spaced_picks(timed, ["physical_group_id"], "n", 30, full=True).collect()} == want[30, True]
