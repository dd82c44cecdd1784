"""Queries over quotas, draws and splits (families F, N and A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtally.functions import keys as K
from landtally.operators import draws, spatial, splits
from landtally.plans.fields import SPLIT
from landtally.plans.registry import R, day_text, query, r6
from landtally.plans.relations import count
from landtally.session import cut_lineage

HASH = lambda seed, x: f"sha256('[{seed}, ' || chr(34) || {x} || chr(34) || ']')"
UNIT = lambda h: f"((CAST(('0x' || substr({h},1,13)) AS BIGINT) + 1.0) / 4503599627370496.0)"
PATH = lambda seed, *cols: f"sha256('[{seed}, [' || concat_ws(', ', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) || ']]')"


@query("F1_quotas8", "WITH g AS (SELECT sampling_group, row_number() OVER (ORDER BY sampling_group) - 1 AS i, count(*) OVER () AS k, (SELECT count(*) FROM orders) AS n FROM (SELECT DISTINCT sampling_group FROM @manifest m)) SELECT sampling_group, CAST(n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g")
def f1(t):
    """Total shared evenly; the first groups take the remainder."""
    total = t.orders.count()
    return draws.even_quotas(t.manifest, "sampling_group", total)


_CLIM = """x AS (SELECT k, c, {n} * (0.5/count(*) OVER () + 0.5*c/sum(c) OVER ()) AS e FROM {src}), y AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, c DESC, k) AS rk FROM x)
 SELECT k AS {name}, CAST(f + CASE WHEN rk <= {n} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y"""


@query("F2_climate_quota", "WITH s AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1), " + _CLIM.format(n=997, src="s", name="c_nationkey"))
def f2(t):
    """Half equal, half proportional, by largest remainder."""
    c = t.customer.groupBy("c_nationkey").agg(count("c"))
    return draws.climate_quotas(c, "c_nationkey", "c", 997).select("c_nationkey", "quota")


@query("F3_maxmin_allocate", """WITH c AS (SELECT l_suppkey % 10 AS p, l_suppkey AS k, count(*) FILTER (WHERE l_discount > 0.08) AS cap, sha256(CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem GROUP BY l_suppkey),
 e AS (SELECT p, k, unnest(range(1, cap + 1)) AS i, h FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY i, h) AS rn FROM e) SELECT c.k AS l_suppkey, count(rn) FILTER (WHERE rn <= 900 - 13 * c.p) AS quota FROM c LEFT JOIN r ON r.k = c.k GROUP BY c.k, c.p""")
def f3(t):
    """Max-min shares of each parent's total."""
    c = t.lineitem.groupBy("l_suppkey").agg(F.count(F.when(F.col("l_discount") > 0.08, 1)).alias("cap"))
    c = c.select((F.col("l_suppkey") % 10).alias("p"), "l_suppkey", "cap", (F.lit(900) - F.col("l_suppkey") % 10 * 13).alias("total"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("h"))
    return draws.maxmin_allocate(c, ["p"], "cap", "total", "h").select("l_suppkey", "quota")


_TOTAL = 2500
_BAL = f"""c AS (SELECT candidate_id, physical_group_id AS g, frequency_bin AS b, landcover AS l, climate_class AS z, year AS y, month AS m, {HASH(43, 'candidate_id')} AS h FROM @candidates c),
 p0 AS (SELECT *, row_number() OVER (PARTITION BY b,l,z,y,m,g ORDER BY h) AS n0 FROM c), p1 AS (SELECT *, row_number() OVER (PARTITION BY b,l,z,y,m ORDER BY n0, {HASH(43, 'g')}) AS n1 FROM p0),
 p2 AS (SELECT *, row_number() OVER (PARTITION BY b,l,z,y ORDER BY n1, {PATH(43, 'b', 'l', 'z', 'y', 'm')}) AS n2 FROM p1), p3 AS (SELECT *, row_number() OVER (PARTITION BY b,l,z ORDER BY n2, {PATH(43, 'b', 'l', 'z', 'y')}) AS n3 FROM p2),
 p4 AS (SELECT *, row_number() OVER (PARTITION BY b,l ORDER BY n3, {PATH(43, 'b', 'l', 'z')}) AS n4 FROM p3), p5 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n4, {PATH(43, 'b', 'l')}) AS n5 FROM p4),
 cap AS (SELECT b, count(*) AS n FROM c GROUP BY b), ex AS (SELECT b, unnest(range(1, n + 1)) AS i FROM cap WHERE b <> 0), q AS (SELECT b, count(*) AS q FROM (SELECT b, row_number() OVER (ORDER BY i, b) AS rn FROM ex) e WHERE rn <= {_TOTAL} GROUP BY b),
 qq AS (SELECT * FROM q UNION ALL SELECT b, least(n, {_TOTAL} - coalesce((SELECT sum(q) FROM q), 0)) FROM cap WHERE b = 0)"""


@query("F4_balanced_draw", f"WITH {_BAL} SELECT p5.b AS frequency_bin, candidate_id FROM p5 JOIN qq ON p5.b = qq.b WHERE n5 <= q")
def f4(t):
    """Hierarchical draw; the comparison text ranks every row instead of counting."""
    return draws.balanced_draw(t.candidates, 43, _TOTAL).select("frequency_bin", "candidate_id")


@query("F4_balance_audit", f"WITH {_BAL} SELECT p5.b AS frequency_bin, l AS landcover, z AS climate_class, y AS year, m AS month, count(*) AS capacity, count(*) FILTER (WHERE n5 <= q) AS quota FROM p5 JOIN qq ON p5.b = qq.b GROUP BY 1, 2, 3, 4, 5")
def f4b(t):
    """Leaf capacities and quotas of the draw."""
    return draws.balanced_draw(t.candidates, 43, _TOTAL, report=True).select("frequency_bin", "landcover", "climate_class", "year", "month", "capacity", "quota")


@query("F5_stratified_picker")
def f5(t):
    """Spaced, balanced picks up to a quota per bin."""
    c = t.candidates
    quotas = c.select("frequency_bin").distinct().withColumn("quota", F.lit(120) + F.col("frequency_bin") * 10)
    return draws.stratified_pick(c, quotas, 43, 30, admissible=F.col("quantity") > 2).select("frequency_bin", "physical_group_id", day_text("target_time").alias("target_time"), "candidate_id", "draw_order")


_LR = "x AS (SELECT {s}, count(*) AS n, {k} * count(*) * 1.0 / sum(count(*)) OVER () AS e FROM @manifest m GROUP BY {s}), y AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, {s}) AS rk FROM x), q AS (SELECT {s}, CAST(f + CASE WHEN rk <= {k} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y)"


@query("F6_largest_remainder", f"WITH {_LR.format(s='split, frequency_bin', k=1001)}, r AS (SELECT sample_id, split, frequency_bin, row_number() OVER (PARTITION BY split, frequency_bin ORDER BY {HASH(42, 'sample_id')}) AS rk FROM @manifest m) SELECT sample_id FROM r JOIN q USING (split, frequency_bin) WHERE rk <= quota")
def f6(t):
    """Proportional quotas per stratum, hash rank inside."""
    return draws.proportional_sample(t.manifest, ["split", "frequency_bin"], 1001, 42).select("sample_id")


@query("F7_nested_subset", """WITH h AS (SELECT *, sha256('42:' || sample_id) AS order_hash, CAST(year(target_time) AS VARCHAR) || ':' || CAST((month(target_time)-1)//3 AS VARCHAR) AS season FROM @manifest m WHERE split = 'train'),
 v AS (SELECT *, row_number() OVER (PARTITION BY spatial_group_id, season ORDER BY order_hash) AS sv FROM h), u AS (SELECT *, row_number() OVER (PARTITION BY spatial_group_id ORDER BY sv, order_hash) AS pv FROM v),
 r AS (SELECT *, row_number() OVER (PARTITION BY sampling_group ORDER BY pv, order_hash) AS rs, count(*) OVER (PARTITION BY sampling_group) AS ns, row_number() OVER (PARTITION BY rare > 0 ORDER BY pv, order_hash) AS rr, row_number() OVER (PARTITION BY common > 0 ORDER BY pv, order_hash) AS rc FROM u)
 SELECT sample_id FROM r WHERE rs <= ceil(ns * 0.1) OR (rare > 0 AND rr <= 64) OR (common > 0 AND rc <= 64) OR pv = 1""")
def f7(t):
    """Nested fraction with label floors and every group kept."""
    m = t.manifest.filter("split = 'train'")
    return draws.nested_subset(m, 0.1, 42, "spatial_group_id", "sampling_group", ["rare", "common"], 64, True).select("sample_id")


@query("F8_conflict_free")
def f8(t):
    """Greedy acceptance by hash rank under spacing and date caps."""
    m = t.manifest.withColumn("rank", K.hash_rank(42, K.quoted(F.col("sample_id"))))
    return draws.conflict_free(m, "sample_id", "rank", "x", "y", "target_time", zone="epsg", max_dates=4).select("sample_id", "epsg", "x", "y", day_text("target_time").alias("target_time"))


@query("F9_max_date_schedule", """WITH RECURSIVE d AS (SELECT DISTINCT physical_group_id AS g, target_time AS t FROM @candidates c WHERE frequency_bin = 3),
 f AS (SELECT g, min(t) AS t FROM d GROUP BY g UNION ALL SELECT f.g, (SELECT min(d.t) FROM d WHERE d.g = f.g AND d.t >= f.t + 30) FROM f WHERE EXISTS (SELECT 1 FROM d WHERE d.g = f.g AND d.t >= f.t + 30)),
 b AS (SELECT g, max(t) AS t FROM d GROUP BY g UNION ALL SELECT b.g, (SELECT max(d.t) FROM d WHERE d.g = b.g AND d.t <= b.t - 30) FROM b WHERE EXISTS (SELECT 1 FROM d WHERE d.g = b.g AND d.t <= b.t - 30)),
 n AS (SELECT g, count(*) AS cap FROM f GROUP BY g)
 SELECT d.g AS physical_group_id, strftime(d.t, '%Y-%m-%d') AS target_time, CAST(cap AS BIGINT) AS capacity, (SELECT count(*) FROM f WHERE f.g = d.g AND f.t <= d.t - 30) + 1 + (SELECT count(*) FROM b WHERE b.g = d.g AND b.t >= d.t + 30) = cap AS feasible FROM d JOIN n ON n.g = d.g""")
def f9(t):
    """Dates of some largest spaced schedule."""
    out = draws.maximum_schedule_dates(t.candidates.filter("frequency_bin = 3"), ["physical_group_id"], "target_time")
    return out.select("physical_group_id", day_text("target_time").alias("target_time"), F.col("capacity").cast("bigint").alias("capacity"), "feasible")


@query("F10_capacity_draw")
def f10(t):
    """A spaced draw that reaches every station's exact capacity."""
    return draws.capacity_picks(t.candidates, 43).select("frequency_bin", "physical_group_id", day_text("target_time").alias("target_time"), "candidate_id", "draw_rank")


@query("F11_refill_plan")
def f11(t):
    """Candidates not yet attempted, up to what the successes leave of each quota."""
    c = t.candidates
    attempts = c.filter("cohort = 0").select("candidate_id", (F.col("quantity") > 10).alias("success"))
    quotas = c.select("frequency_bin").distinct().withColumn("quota", F.lit(150) + F.col("frequency_bin") * 10)
    return draws.refill_plan(c, attempts, quotas, 44).select("frequency_bin", "physical_group_id", day_text("target_time").alias("target_time"), "candidate_id", "draw_order")


@query("F12_split_targets", """WITH n AS (SELECT count(*) + 1205 AS t FROM @candidates c WHERE valid_et > 0), h AS (SELECT split, count(*) AS present FROM @candidates c WHERE valid_et > 0 GROUP BY split), g AS (SELECT split, CASE WHEN split = 'train' THEN t - 2*CAST(round_even(t*0.15,0) AS BIGINT) ELSE CAST(round_even(t*0.15,0) AS BIGINT) END AS target FROM n, (VALUES ('train'),('validation'),('test')) v(split))
 SELECT split, coalesce(present,0) AS present, target, target - coalesce(present,0) AS deficit FROM g LEFT JOIN h USING (split)""")
def f12(t):
    """Rows each split still lacks."""
    return draws.split_deficits(t.candidates.filter("valid_et > 0"), "split", 1205)


@query("F13_month_diverse")
def f13(t):
    """Least-used month first, dates apart, per station."""
    return draws.month_diverse_windows(t.candidates, ["physical_group_id"], 40, 12).select("physical_group_id", day_text("target_time").alias("target_time"), "pick")


@query("F14_weighted_sample", f"""WITH r AS (SELECT candidate_id, quantity, {HASH(9, 'candidate_id')} AS h FROM @candidates c), c AS (SELECT *, sum(quantity) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS hi, sum(quantity) OVER () AS tot FROM r),
 u AS (SELECT i AS draw, {UNIT("sha256('[9, ' || chr(34) || 'draw' || chr(34) || ', ' || i || ']')")} AS u FROM range(1, 501) x(i)) SELECT draw, candidate_id FROM u JOIN c ON u.u * tot > hi - quantity AND u.u * tot <= hi""")
def f14(t):
    """Draws with replacement in proportion to weight."""
    return draws.weighted_draws(t.candidates, "candidate_id", "quantity", 500, 9)


@query("F15_population_priority", f"SELECT sample_id, {R('-ln(greatest(' + UNIT(HASH(5, 'sample_id')) + ', 1e-12)) / (o_totalprice / count(*) OVER (PARTITION BY sampling_group))', 9)} AS priority FROM @manifest m")
def f15(t):
    """Priority that samples in proportion to population."""
    out = draws.population_priority(t.manifest, ["sampling_group"], "o_totalprice", 5)
    return out.select("sample_id", r6("priority", 9).alias("priority"))


@query("F16_quantile_probe", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS position, count(*) OVER () AS n FROM documents), k AS (SELECT DISTINCT CAST(round_even(j * (n - 1) / 24.0, 0) AS BIGINT) + 1 AS position FROM (SELECT max(n) AS n FROM r) a, range(0, 25) q(j)) SELECT doc_id, n_chars, position FROM r JOIN k USING (position)")
def f16(t):
    """Evenly spaced ranks by size."""
    return draws.quantile_probe(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 25).select("doc_id", "n_chars", "position")


@query("F17_audit_picks", """SELECT 'group' AS kind, CAST(sampling_group AS VARCHAR) AS name, max(sample_id) AS sample_id FROM @manifest m GROUP BY sampling_group UNION ALL SELECT 'class', CAST(climate_class AS VARCHAR), max(sample_id) FROM @manifest m GROUP BY climate_class""")
def f17(t):
    """One sample per group and one per class."""
    m = t.manifest
    one = lambda c, k: m.groupBy(F.col(c).cast("string").alias("name")).agg(F.max("sample_id").alias("sample_id")).withColumn("kind", F.lit(k))
    return one("sampling_group", "group").unionByName(one("climate_class", "class")).select("kind", "name", "sample_id")


@query("F19_heldout_groups")
def f19(t):
    """Whole connected groups held out of every cohort."""
    c = t.candidates.select("cohort", "physical_group_id", "spatial_group_id")
    return splits.heldout_groups(c, "cohort")


@query("F20_dev_block_holdout", f"WITH b AS (SELECT DISTINCT block FROM @manifest m), r AS (SELECT block, row_number() OVER (ORDER BY {HASH(42, 'block')}) AS rk, count(*) OVER () AS n FROM b) SELECT sample_id, m.block, rk <= ceil(n*0.2) AS development FROM @manifest m JOIN r ON r.block = m.block")
def f20(t):
    """A fifth of the blocks to development."""
    m = t.manifest
    out = draws.block_holdout(m.drop("block"), K.geographic_block(F.col("lon"), F.col("lat")), 0.2, 42)
    return out.select("sample_id", "block", "development")


@query("F21_planned_quotas", f"""WITH cells AS (SELECT DISTINCT frequency_bin AS b, year AS y, climate_class AS z, count(*) OVER (PARTITION BY frequency_bin, year, climate_class) AS pool FROM @manifest m), fb AS (SELECT b, 705 // 7 + CASE WHEN row_number() OVER (ORDER BY b) <= 705 % 7 THEN 1 ELSE 0 END AS q FROM (SELECT DISTINCT b FROM cells) a),
 yy AS (SELECT b, y, q // count(*) OVER (PARTITION BY b) + CASE WHEN row_number() OVER (PARTITION BY b ORDER BY y) <= q % count(*) OVER (PARTITION BY b) THEN 1 ELSE 0 END AS q FROM (SELECT DISTINCT cells.b, y, fb.q FROM cells JOIN fb ON cells.b = fb.b) s),
 zz AS (SELECT c.b, c.y, c.z, c.pool, yy.q * (0.5/count(*) OVER (PARTITION BY c.b, c.y) + 0.5*pool/sum(pool) OVER (PARTITION BY c.b, c.y)) AS e, yy.q AS t FROM cells c JOIN yy ON yy.b = c.b AND yy.y = c.y),
 rr AS (SELECT *, row_number() OVER (PARTITION BY b, y ORDER BY e - floor(e) DESC, pool DESC, z) AS rk, t - sum(floor(e)) OVER (PARTITION BY b, y) AS lft FROM zz), qq AS (SELECT b, y, z, pool, CAST(floor(e) + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM rr)
 SELECT b AS frequency_bin, y AS year, z AS climate_class, quota, least(quota, pool) AS taken, greatest(0, quota - pool) AS deficit FROM qq""")
def f21(t):
    """Bin, year and climate quotas, filled by priority, with deficits reported."""
    from landtally.operators.planning import planned_draw

    return planned_draw(t.manifest, "frequency_bin", "year", "climate_class", 705, 42)[1].select("frequency_bin", "year", "climate_class", "quota", "taken", "deficit")


@query("F22_block_sample", f"WITH r AS (SELECT block, frequency_bin, sample_id, row_number() OVER (PARTITION BY block, frequency_bin ORDER BY {HASH(3, 'sample_id')}) AS draw FROM @manifest m) SELECT block, frequency_bin, sample_id, draw, {HASH(3, 'block')} AS block_order FROM r WHERE draw <= 2")
def f22(t):
    """Two rows of each class in each block."""
    return draws.block_sample(t.manifest, ["block"], "frequency_bin", 2, 3).select("block", "frequency_bin", "sample_id", "draw", "block_order")


@query("A14_freeze_snapshot", f"""WITH {_LR.format(s='split, frequency_bin', k=3000)}, p AS (SELECT sample_id FROM @manifest m WHERE o_orderkey % 37 = 0), m AS (SELECT sample_id, split, frequency_bin FROM @manifest m), o AS (SELECT * FROM m WHERE sample_id IN (SELECT sample_id FROM p)),
 h AS (SELECT split, frequency_bin, count(*) AS held FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split, frequency_bin ORDER BY {HASH(42, 'sample_id')}) AS rk FROM m WHERE sample_id NOT IN (SELECT sample_id FROM p))
 SELECT sample_id, 'kept' AS status FROM o UNION ALL SELECT sample_id, 'added' FROM r JOIN q USING (split, frequency_bin) LEFT JOIN h USING (split, frequency_bin) WHERE rk <= quota - coalesce(held, 0)""")
def a14(t):
    """A published subset extended without touching its old rows."""
    m = t.manifest
    return draws.extend_snapshot(m, m.filter("o_orderkey % 37 = 0"), ["split", "frequency_bin"], 3000, 42).select("sample_id", "status")


# --- N ------------------------------------------------------------------------------------------

@query("N1_geographic_split", f"SELECT location_id, {SPLIT(HASH(43, 'blk'))} AS split FROM (SELECT location_id, concat(CAST(CAST(floor((lon+180)/5) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor((lat+90)/5) AS BIGINT) AS VARCHAR)) AS blk FROM @stations s WHERE lon IS NOT NULL) b")
def n1(t):
    """Split of the block a station lies in."""
    s = t.stations.filter("lon is not null")
    return s.select("location_id", K.geographic_split(F.col("lon"), F.col("lat"), 43).alias("split"))


def _products(t):
    return t.supplier.select(F.col("s_suppkey").alias("product_id"), ((F.col("s_suppkey") * 5 * 3733 % 36000) / 100.0 - 180.0 + 0.01).alias("lon"), ((F.col("s_suppkey") * 5 * 1777 % 12000) / 100.0 - 60.0).alias("lat"),
                             F.when(F.col("s_suppkey") % 3 == 0, 16502.0).otherwise(850.0).alias("radius_m"), F.when(F.col("s_suppkey") % 4 == 0, "train").otherwise("test").alias("split"))


@query("N2_assign_splits")
def n2(t):
    """Spatial and physical groups of stations and one split per group."""
    out = splits.assign_splits(t.stations.select("location_id", "group_id", "lon", "lat"), _products(t), 43, development=F.col("group_id") == "site4")
    return out.select("location_id", "physical_group_id", "spatial_group_id", "split", "split_reason", "product_overlap_count")


@query("N2_product_selection")
def n2b(t):
    """Evaluation products that meet train stations are dropped."""
    s = splits.assign_splits(t.stations.select("location_id", "group_id", "lon", "lat"), _products(t), 43)
    hits = splits.product_hits(s.filter("split = 'train'"), _products(t)).withColumn("site_split", F.lit("train"))
    return splits.product_selection(_products(t), hits).select("product_id", "split")


_COV = """l AS (SELECT frequency_bin, task, spatial_group_id AS g, max(CASE WHEN CAST(spatial_group_id AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END) AS lk FROM (SELECT frequency_bin, 'sm' AS task, spatial_group_id FROM @candidates c WHERE valid_sm > 0 UNION ALL SELECT frequency_bin, 'et', spatial_group_id FROM @candidates c WHERE valid_et > 0) x GROUP BY ALL),
 a AS (SELECT frequency_bin, task, count(*) AS n, CAST(sum(1 - lk) AS BIGINT) AS f FROM l GROUP BY ALL)"""


@query("N3_task_coverage", f"WITH {_COV} SELECT frequency_bin, task, n AS spatial_groups, f AS free_groups, n >= 3 AND f >= 2 AS feasible, CASE WHEN n >= 3 AND f >= 2 THEN least(2, (n-1)//2, f//2) ELSE 0 END AS minimum_evaluation FROM a")
def n3(t):
    """Independent groups per bin and task and the minimum each split must keep."""
    c = t.candidates
    locked = c.filter("cast(spatial_group_id as bigint) % 4 = 0").select("spatial_group_id").distinct()
    return splits.task_coverage(c, locked).select("frequency_bin", "task", "spatial_groups", "free_groups", "feasible", "minimum_evaluation")


@query("N4_stratify_groups")
def n4(t):
    """Whole groups to three splits with task minimums and window shares."""
    c = t.candidates
    locked = c.filter("cast(spatial_group_id as bigint) % 12 = 0").select("spatial_group_id").distinct()
    return splits.stratify_groups(c, locked)


@query("N5_resplit_cohorts")
def n5(t):
    """New group splits applied to every cohort, with the distribution by bin and split."""
    from landtally.operators.planning import resplit

    c = t.candidates
    locked = c.filter("cast(spatial_group_id as bigint) % 12 = 0").select("spatial_group_id").distinct()
    return resplit(c, locked, 43)[1]


@query("N6_rebalance_et")
def n6(t):
    """Evaluation groups kept up to the target share, the rest promoted to train."""
    return splits.rebalance_et(t.candidates.withColumn("valid_sm", F.when(F.col("spatial_group_id").cast("bigint") % 10 == 7, F.col("valid_sm")).otherwise(0)), 43)


@query("N7_assign_et_splits")
def n7(t):
    """Groups that met products or were train stay train; the others are drawn again."""
    c = t.candidates
    locked = c.filter("split = 'train' or spatial_group_id = '8'").select("spatial_group_id").distinct()
    return splits.stratify_groups(c.filter("valid_et > 0"), locked)


@query("N8_training_overlap")
def n8(t):
    """Windows within the margin of any training circle, whatever its date."""
    from landtally.operators.planning import training_overlap

    s = t.stations.filter("lon is not null").select("location_id", "lon", "lat").withColumn("radius_m", F.lit(850.0))
    return training_overlap(s, _products(t), 35000.0, "location_id", "product_id")


@query("N9_supplement_plan", """WITH w AS (SELECT candidate_id, physical_group_id, target_time, quantity FROM @candidates c WHERE frequency_bin = 2), a AS (SELECT DISTINCT physical_group_id, target_time FROM w WHERE quantity >= 40)
 SELECT candidate_id, 'recovered' AS origin FROM w WHERE quantity >= 30 AND quantity < 40 UNION ALL SELECT candidate_id, 'unused_date' FROM w WHERE quantity < 30 AND (physical_group_id, target_time) NOT IN (SELECT (physical_group_id, target_time) FROM a)""")
def n9(t):
    """Rows recovered under a relaxed threshold and rows of unused dates."""
    from landtally.operators.planning import supplement

    w = t.candidates.filter("frequency_bin = 2")
    return supplement(w, F.col("quantity") >= 40, F.col("quantity") >= 30, ["physical_group_id", "target_time"]).select("candidate_id", "origin")


@query("N10_revision_plan")
def n10(t):
    """Failing stations dropped, evaluation rebalanced, new candidates and split deficits."""
    from landtally.operators.planning import revision

    c = t.candidates
    passing = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("physical_group_id"))
    pool = c.filter("cohort = 2")
    return revision(c.filter("cohort < 2"), passing, pool, 1200, 43)
