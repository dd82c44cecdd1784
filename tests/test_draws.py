"""Draws, exclusion, components and splits against brute force."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from landtally.operators import draws, spatial, splits


def waterfill(caps, count):
    out, left = {k: 0 for k in caps}, min(count, sum(caps.values()))
    while left:
        for k in sorted(caps):
            if left and out[k] < caps[k]:
                out[k] += 1
                left -= 1
    return out


def test_maxmin_golden_and_random(spark):
    rng = random.Random(5)
    cases = [({1: 1, 2: 100, 3: 100}, 21)] + [({k: rng.randint(0, 9) for k in range(rng.randint(1, 8))}, rng.randint(0, 40)) for _ in range(12)]
    rows = [(i, k, c, n, f"{k:08x}") for i, (caps, n) in enumerate(cases) for k, c in caps.items()]
    df = spark.createDataFrame(rows, "p int, k int, cap long, total long, h string")
    got = {}
    for r in draws.maxmin_allocate(df, ["p"], "cap", "total", "h").collect():
        got.setdefault(r.p, {})[r.k] = r.quota
    for i, (caps, n) in enumerate(cases):
        assert got[i] == waterfill(caps, n)
    assert got[0] == {1: 1, 2: 10, 3: 10}


def test_zero_bin_gets_the_leftover(spark):
    df = spark.createDataFrame([(0, 20), (1, 1)], "frequency_bin int, n long")
    assert {r.frequency_bin: r.quota for r in draws.frequency_quotas(df, "frequency_bin", 17).collect()} == {0: 16, 1: 1}


def longest(days, gap):
    best = 0
    for n in range(len(days), 0, -1):
        if any(all(b - a >= gap for a, b in zip(c, c[1:])) for c in itertools.combinations(days, n)):
            return n
    return best


def test_schedule_and_capacity(spark):
    rng = random.Random(9)
    sets = {s: sorted(rng.sample(range(0, 120), 8)) for s in "abcd"}
    base = dt.date(2020, 1, 1)
    rows = [(s, base + dt.timedelta(days=d), f"{s}{d}-{j}", d) for s, ds in sets.items() for d in ds for j in range(2)]
    df = spark.createDataFrame(rows, "physical_group_id string, target_time date, candidate_id string, d int")
    out = draws.maximum_schedule_dates(df, ["physical_group_id"], "target_time").collect()
    for r in out:
        ds, d = sets[r.physical_group_id], (r.target_time - base).days
        cap = longest(ds, 30)
        with_d = max(longest([x for x in ds if x <= d - 30], 30) + 1 + longest([x for x in ds if x >= d + 30], 30), 1)
        assert r.capacity == cap and r.feasible == (with_d == cap)
    ranked = df.withColumn("rank", F.sha2("candidate_id", 256))
    full = draws.spaced_picks(ranked, ["physical_group_id"], "rank", 30, full=True).collect()
    for s, ds in sets.items():
        picks = sorted(r.d for r in full if r.physical_group_id == s)
        assert len(picks) == longest(ds, 30) and all(b - a >= 30 for a, b in zip(picks, picks[1:]))


def test_conflict_free_equals_sequential(spark):
    rng = random.Random(2)
    base = dt.date(2020, 1, 1)
    pts = [(i, float(rng.randrange(6) * 700), float(rng.randrange(6) * 700), rng.randrange(200)) for i in range(150)]
    df = spark.createDataFrame([(i, x, y, base + dt.timedelta(days=d)) for i, x, y, d in pts], "id int, x double, y double, day date")
    df = df.withColumn("rank", F.sha2(F.col("id").cast("string"), 256))
    order = [r.id for r in df.orderBy("rank").collect()]
    got = {r.id for r in draws.conflict_free(df, "id", "rank", "x", "y", "day", max_dates=2).collect()}
    by, kept = {p[0]: p for p in pts}, []
    for i in order:
        _, x, y, d = by[i]
        if sum((a[1], a[2]) == (x, y) for a in kept) >= 2:
            continue
        if any(abs(a[1] - x) < 1200 and abs(a[2] - y) < 1200 and abs(a[3] - d) < 40 for a in kept):
            continue
        kept.append(by[i])
    assert got == {k[0] for k in kept}


def test_components_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 90)]
    nodes = spark.range(100).select(F.col("id").cast("int").alias("k"))
    got = {r.k: r.component for r in spatial.components(nodes, spark.createDataFrame(edges, "a int, b int"), "k").collect()}
    parent = list(range(100))
    def root(i):
        return i if parent[i] == i else root(parent[i])
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(100)}


def test_links_and_circles_match_all_pairs(spark):
    from landtally.functions.geo import vincenty_m

    rng = random.Random(8)
    pts = [(i, 10 + rng.random() * 0.2, 50 + rng.random() * 0.2) for i in range(60)] + [(60, 179.999, 0.0), (61, -179.999, 0.0), (62, 10.05, 50.05), (63, 10.05, 50.05)]
    df = spark.createDataFrame(pts, "k int, lon double, lat double")
    got = {r.k: r.component for r in spatial.components(df.select("k"), spatial.distance_links(df, "k", 1700.0), "k").collect()}
    n = len(pts)
    near = [(a, b) for a in range(n) for b in range(a) if vincenty_m([pts[a][1]], [pts[a][2]], [pts[b][1]], [pts[b][2]])[0] <= 1700]
    parent = list(range(n))
    def root(i):
        return i if parent[i] == i else root(parent[i])
    for a, b in near:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(n)} and got[61] == 60
    left = df.select(F.col("k").alias("left_id"), "lon", "lat").withColumn("radius_m", F.lit(500.0))
    right = df.select(F.col("k").alias("right_id"), "lon", "lat").withColumn("radius_m", F.when(F.col("right_id") % 2 == 0, 1200.0).otherwise(300.0))
    pairs = {(r.left_id, r.right_id) for r in spatial.circles_overlap(left, right, cell_m=900.0).collect()}
    want = {(a, b) for a in range(n) for b in range(n) if vincenty_m([pts[a][1]], [pts[a][2]], [pts[b][1]], [pts[b][2]])[0] <= 500 + (1200 if b % 2 == 0 else 300)}
    assert pairs == want


def table(spark):
    rng = random.Random(6)
    rows = []
    for g in range(60):
        for w in range(rng.randint(1, 6)):
            rows.append((f"g{g}", f"p{g}", g % 4, rng.randint(0, 1), 1, "train" if g % 3 else ("validation" if g % 2 else "test")))
    return spark.createDataFrame(rows, "spatial_group_id string, physical_group_id string, frequency_bin int, valid_sm int, valid_et int, split string")


def test_stratified_groups_hold_their_guarantees(spark):
    df = table(spark)
    locked = df.filter("spatial_group_id in ('g1', 'g2')").select("spatial_group_id").distinct()
    plan = splits.stratify_groups(df, locked)
    again = {r.spatial_group_id: r.split for r in splits.stratify_groups(df.repartition(7), locked).collect()}
    got = {r.spatial_group_id: r.split for r in plan.collect()}
    assert got == again and len(got) == 60 and got["g1"] == got["g2"] == "train"
    need = {(r.frequency_bin, r.task): r.minimum_evaluation for r in splits.task_coverage(df, locked).collect()}
    rows = df.collect()
    for (b, task), m in need.items():
        for s in ("validation", "test"):
            have = {r.spatial_group_id for r in rows if r.frequency_bin == b and r[f"valid_{task}"] > 0 and got[r.spatial_group_id] == s}
            assert len(have) >= m


def test_rebalance_never_exposes_train(spark):
    df = table(spark).withColumn("valid_sm", F.when(F.col("spatial_group_id") == "g3", 1).otherwise(0))
    out = {r.spatial_group_id: r for r in splits.rebalance_et(df).collect()}
    assert all(r.split == "train" for r in out.values() if r.previous_split == "train")
    assert out["g3"].split == out["g3"].previous_split
    assert any(r.split == "train" and r.previous_split != "train" for r in out.values())


def test_holdout_leaves_every_cohort_a_group(spark):
    rows = [(c, f"s{g}", f"p{g // 2}") for c in range(3) for g in range(c, 20) for _ in range(3)]
    df = spark.createDataFrame(rows, "cohort int, spatial_group_id string, physical_group_id string")
    out = splits.heldout_groups(df, "cohort").collect()
    for c in range(3):
        mine = [r for r in out if r.cohort == c]
        assert any(not r.heldout for r in mine) and sum(r.rows for r in mine if r.heldout) >= round(0.1 * sum(r.rows for r in mine))
    state = {}
    for r in out:
        assert state.setdefault(r.group, r.heldout) == r.heldout


def _pool(spark):
    import datetime
    rng = random.Random(8)
    rows = []
    for k in range(240):
        station = rng.randrange(14)
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=8 * rng.randrange(90))
        rows.append((f"c{k}", station % 3, f"s{station}" if station < 12 else "hot", rng.choice((0, 0, 0, 1)), rng.randrange(2), day.year, day.month, day))
    return rows, spark.createDataFrame(rows, "candidate_id string, frequency_bin int, physical_group_id string, landcover int, climate_class int, year int, month int, target_time date")


def _check_picks(rows, picked, quotas, gap, before=()):
    """Gaps hold, quotas are met unless nothing eligible is left, and siblings differ by more than one only where the lesser is used up."""
    from collections import Counter
    by = {r[0]: r for r in rows}
    taken = [by[i] for i in (*picked, *before)]
    for a in taken:
        for b in taken:
            assert a[0] == b[0] or a[2] != b[2] or abs((a[7] - b[7]).days) >= gap
    free = [r for r in rows if r not in taken and all(t[2] != r[2] or abs((t[7] - r[7]).days) >= gap for t in taken)]
    for bin_, quota in quotas.items():
        n = sum(r[1] == bin_ for r in taken)
        assert n <= quota and (n == quota or not any(r[1] == bin_ for r in free))
    for depth in ((1, 3, 4), (1, 3, 4, 5), (1, 3, 4, 5, 6)):
        path = lambda r: tuple(r[k] for k in depth)
        up = lambda p: p[:1] if len(depth) == 3 else p[:-1]
        have, open_ = Counter(map(path, taken)), {path(r) for r in free}
        for p in open_:
            most = max((n for q, n in have.items() if up(q) == up(p)), default=0)
            assert most - have[p] <= 1, (p, have[p], most)


def test_stratified_pick_is_balanced_and_spaced(spark):
    rows, df = _pool(spark)
    quotas = {0: 40, 1: 25, 2: 500}
    table = spark.createDataFrame(list(quotas.items()), "frequency_bin int, quota long")
    out = draws.stratified_pick(df, table, 7, 40).collect()
    _check_picks(rows, [r.candidate_id for r in out], quotas, 40)
    for b in quotas:
        assert sorted(r.draw_order for r in out if r.frequency_bin == b) == list(range(1, sum(r.frequency_bin == b for r in out) + 1))
    again = draws.stratified_pick(df.repartition(7), table, 7, 40).collect()
    assert {(r.candidate_id, r.draw_order) for r in again} == {(r.candidate_id, r.draw_order) for r in out}


def test_refill_counts_successes_only(spark):
    rows, df = _pool(spark)
    first = [r for r in rows if r[2] == "s1"]
    won, lost = first[0], [r for r in rows if r[2] == "s4"]
    attempts = spark.createDataFrame([(won[0], True)] + [(r[0], False) for r in lost], "candidate_id string, success boolean")
    quotas = {0: 10, 1: 10, 2: 10}
    table = spark.createDataFrame(list(quotas.items()), "frequency_bin int, quota long")
    picked = [r.candidate_id for r in draws.refill_plan(df, attempts, table, 3, 40).collect()]
    assert won[0] not in picked and not {r[0] for r in lost} & set(picked) and len(picked) == 29
    _check_picks([r for r in rows if r not in lost], picked, quotas, 40, [won[0]])


def test_capacity_draw_refuses_stations_in_two_bins(spark):
    rows, df = _pool(spark)
    import pytest
    with pytest.raises(ValueError, match="hot"):
        draws.capacity_draw(df, 1)


def test_top_up_levels_from_what_is_there(spark):
    import itertools
    rng = random.Random(5)
    rows = [(p, f"{p}-{k}", rng.randrange(6), rng.randrange(7), 0) for p in range(30) for k in range(rng.randrange(1, 6))]
    totals = {p: rng.randrange(0, 25) for p in range(30)}
    rows = [(p, k, h, c, totals[p]) for p, k, h, c, _ in rows]
    df = spark.createDataFrame(rows, "p int, k string, had int, cap int, total int").withColumn("_h", F.sha2("k", 256))
    got = {(r.p, r.k): r.quota for r in draws.maxmin_top_up(df, ["p"], "had", "cap", "total", "_h").collect()}
    for p, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        given = [got[p, r[1]] for r in group]
        assert sum(given) == min(totals[p], sum(r[3] for r in group)) and all(0 <= g <= r[3] for g, r in zip(given, group))
        full = [r[2] + g for g, r in zip(given, group)]
        for (g, r), (h, q) in itertools.permutations(zip(given, group), 2):
            assert not (g > 0 and r[2] + g > q[2] + h + 1 and h < q[3]), (p, full)


def test_month_diverse_windows(spark):
    """The least-used month always goes first, dates keep the gap, and nothing that could be added is left."""
    rng = random.Random(2)
    days = sorted({dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(700)) for _ in range(60)})
    df = spark.createDataFrame([(s, d) for s in "ab" for d in days], "s string, target_time date")
    out = {}
    for r in draws.month_diverse_windows(df, ["s"], 25).collect():
        out.setdefault(r.s, {})[r.pick] = r.target_time
    for s, picks in out.items():
        used, taken = {}, []
        for k in range(1, len(picks) + 1):
            free = [d for d in days if d not in taken and all(abs((d - t).days) >= 25 for t in taken)]
            d = picks[k]
            assert d in free and used.get(d.month, 0) == min(used.get(f.month, 0) for f in free)
            used[d.month] = used.get(d.month, 0) + 1
            taken.append(d)
        assert not [d for d in days if d not in taken and all(abs((d - t).days) >= 25 for t in taken)]
    assert out["a"] != out["b"]  # the order of ties is the station's own


def test_weighted_draws(spark):
    """Shares of the draws follow the weights, tiny and zero ones included; nothing is drawn from nothing."""
    rows = [("big", 500.0), ("half", 250.0), ("zero", 0.0), ("null", None)] + [(f"t{k}", 0.25) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, w double").repartition(5)
    out = [r.k for r in draws.weighted_draws(df, "k", "w", 4000, 3).collect()]
    assert len(out) == 4000 and not {"zero", "null"} & set(out)
    assert abs(out.count("big") - 2000) < 150 and abs(out.count("half") - 1000) < 130 and len(set(out)) > 500
    assert sorted(out) == sorted(r.k for r in draws.weighted_draws(df.repartition(2), "k", "w", 4000, 3).collect())
    assert draws.weighted_draws(df.filter("w < 0"), "k", "w", 10, 3).count() == 0
