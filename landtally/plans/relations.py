"""Queries over joins, aggregates, rankings, sets and checks (families C, D, E, G, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtally.functions import bins, keys as K
from landtally.operators import checks, draws, joins, metrics, ordered, pixels, sets
from landtally.plans.fields import SPLIT
from landtally.plans.registry import D, R, day_text, query, r6

count = lambda name="n": F.count(F.lit(1)).alias(name)
isum = lambda c, name: F.sum(c.cast("int") if not isinstance(c, str) else F.col(c).cast("int")).alias(name)


# --- C ------------------------------------------------------------------------------------------

@query("C1_lookup_join", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand, CAST(1 AS BIGINT) AS lookup_matches FROM lineitem JOIN part ON l_partkey = p_partkey")
def c1(t):
    """Many-to-one lookup that carries the number of matches of its key."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = joins.lookup(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), p, ["l_partkey"], "inner")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_brand", "lookup_matches")


@query("C2_left_null_strata", "SELECT s.location_id, p.p_size AS stratum, CASE WHEN p.p_size IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM @stations s LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) p ON s.c_custkey = p.p_partkey")
def c2(t):
    """Stations without a stratum stay, unresolved."""
    p = t.part.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("c_custkey"), F.col("p_size").alias("stratum"))
    out = t.stations.join(p, "c_custkey", "left")
    return out.select("location_id", "stratum", F.when(F.col("stratum").isNull(), "unresolved").otherwise("resolved").alias("status"))


@query("C3_semi_anti", """SELECT 'selected' AS side, count(*) AS n FROM @candidates c WHERE physical_group_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)
 UNION ALL SELECT 'remaining', count(*) FROM @candidates c WHERE (physical_group_id, target_time) NOT IN (SELECT (physical_group_id, target_time) FROM @candidates d WHERE cohort = 0)""")
def c3(t):
    """Keep selected ids; drop attempted station-date keys."""
    c = t.candidates
    good = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("physical_group_id"))
    done = c.filter("cohort = 0").select("physical_group_id", "target_time").distinct()
    a = c.join(good, "physical_group_id", "left_semi").agg(count()).withColumn("side", F.lit("selected"))
    b = c.join(done, ["physical_group_id", "target_time"], "left_anti").agg(count()).withColumn("side", F.lit("remaining"))
    return a.unionByName(b).select("side", "n")


def _paired(t):
    day = F.timestamp_seconds("t_s").cast("date")
    x = t.sensor.withColumn("day", day)
    s = x.filter("good and sensor % 7 <> 0").groupBy("sensor", "day").agg(F.avg("value").alias("station_value"))
    p = x.filter("sensor % 5 <> 0").groupBy("sensor", "day").agg((F.avg("value") * 1.2).alias("product_value"), F.when(F.col("sensor") % 11 != 0, F.min(F.col("event_id") % 5)).alias("qa"))
    return joins.pair_days(s, p, ["sensor", "day"])


@query("C9_common_day_pairing", f"""WITH s AS (SELECT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day, avg(value) AS station_value FROM @sensor x WHERE good AND sensor % 7 <> 0 GROUP BY ALL),
 p AS (SELECT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day, avg(value)*1.2 AS product_value, CASE WHEN min(sensor) % 11 <> 0 THEN min(event_id % 5) END AS qa FROM @sensor x WHERE sensor % 5 <> 0 GROUP BY ALL)
 SELECT coalesce(s.sensor, p.sensor) AS sensor, {D('coalesce(s.day, p.day)')} AS day, {R('station_value')} AS station_value, {R('product_value')} AS product_value,
  CASE WHEN p.sensor IS NULL THEN 'no_product_day' WHEN qa IS NULL OR qa <> 0 THEN 'product_quality' WHEN s.sensor IS NULL THEN 'no_station_morning' WHEN product_value NOT BETWEEN 0 AND 1 THEN 'product_range' END AS reason FROM s FULL JOIN p ON s.sensor = p.sensor AND s.day = p.day""")
def c9(t):
    """Common days, with the reason of each excluded day from both sides."""
    return _paired(t).select("sensor", day_text("day").alias("day"), r6("station_value").alias("station_value"), r6("product_value").alias("product_value"), "reason")


@query("C9_common_days", f"""WITH s AS (SELECT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day, avg(value) AS station_value FROM @sensor x WHERE good AND sensor % 7 <> 0 GROUP BY ALL),
 p AS (SELECT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day, avg(value)*1.2 AS product_value, CASE WHEN min(sensor) % 11 <> 0 THEN min(event_id % 5) END AS qa FROM @sensor x WHERE sensor % 5 <> 0 GROUP BY ALL)
,
 d AS (SELECT coalesce(s.sensor, p.sensor) AS sensor, date_trunc('month', coalesce(s.day, p.day)) AS m, station_value, product_value,
  CASE WHEN p.sensor IS NULL THEN 'no_product_day' WHEN qa IS NULL OR qa <> 0 THEN 'product_quality' WHEN s.sensor IS NULL THEN 'no_station_morning' WHEN product_value NOT BETWEEN 0 AND 1 THEN 'product_range' END AS reason FROM s FULL JOIN p ON s.sensor = p.sensor AND s.day = p.day)
 SELECT sensor, {D('m')} AS month, count(*) FILTER (reason IS NULL) AS common_days, count(*) FILTER (reason IS NOT NULL) AS excluded_days, {R('avg(station_value) FILTER (reason IS NULL)', 9)} AS site_value,
  {R('avg(product_value) FILTER (reason IS NULL)', 9)} AS product_value, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN NULL WHEN count(*) FILTER (reason IS NULL OR reason <> 'no_product_day') > 0 THEN 'no_common_valid_dates' ELSE 'no_product_in_window' END AS reason FROM d GROUP BY 1, m""")
def c9b(t):
    """Common days of each sensor and month with the means of both sides, or why there are none."""
    out = joins.common_days(_paired(t).withColumn("month", F.trunc("day", "month")), ["sensor", "month"])
    return out.select("sensor", day_text("month").alias("month"), "common_days", "excluded_days", r6("site_value", 9).alias("site_value"), r6("product_value", 9).alias("product_value"), "reason")


_REC = "SELECT physical_group_id AS station, target_time, target_end, avg(quantity) AS station_value FROM @candidates c GROUP BY 1, 2, 3"


@query("C10_period_pairing", f"""WITH r AS ({_REC}), p AS (SELECT station, target_time, CASE WHEN CAST(station AS BIGINT) % 9 = 0 THEN CAST(target_end - 1 AS DATE) ELSE target_end END AS target_end, CASE WHEN CAST(station AS BIGINT) % 4 = 0 THEN -1.0 ELSE station_value * 0.9 END AS product_value FROM r WHERE CAST(station AS BIGINT) % 5 <> 0)
 SELECT r.station, {D('r.target_time')} AS target_time, {R('product_value')} AS product_value, CASE WHEN p.station IS NULL THEN 'no_product_period' WHEN p.target_end <> r.target_end THEN 'period_mismatch' WHEN product_value < 0 THEN 'missing_or_negative_product' END AS reason
 FROM r LEFT JOIN p ON r.station = p.station AND r.target_time = p.target_time""")
def c10(t):
    """Exact period equality, else a reason."""
    r = t.candidates.groupBy(F.col("physical_group_id").alias("station"), "target_time", "target_end").agg(F.avg("quantity").alias("station_value"))
    n = F.col("station").cast("bigint")
    p = r.filter(n % 5 != 0).select("station", "target_time", F.when(n % 9 == 0, F.date_sub("target_end", 1)).otherwise(F.col("target_end")).alias("target_end"), F.when(n % 4 == 0, -1.0).otherwise(F.col("station_value") * 0.9).alias("product_value"))
    out = joins.pair_periods(r, p, "station", "target_time", "target_end")
    return out.select("station", day_text("target_time").alias("target_time"), r6("product_value").alias("product_value"), "reason")


@query("C16_prediction_attach", """SELECT count(*) AS n, CAST(sum(CASE WHEN n.n_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN abs(p.target - p.target * CASE WHEN l_partkey % 50 = 0 THEN 1.01 ELSE 1 END) > 1e-8 + 1e-5*abs(p.target) THEN 1 ELSE 0 END) AS BIGINT) AS disagreeing
 FROM @pairs p LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = p.site""")
def c16(t):
    """Predictions joined to station metadata; labels must agree."""
    meta = t.nation.select(F.col("n_nationkey").cast("string").alias("site"), "n_name")
    p = joins.lookup(t.pairs, meta, ["site"])
    label = F.col("target") * F.when(F.col("l_partkey") % 50 == 0, 1.01).otherwise(1.0)
    bad = ~bins.close_to(label, F.col("target"), 1e-5, 1e-8)
    return p.agg(count(), isum(F.col("n_name").isNull(), "missing"), isum(bad, "disagreeing"))


@query("C17_common_support", "SELECT task, count(*) AS n FROM @pairs p WHERE eligible AND valid_a AND valid_b GROUP BY task")
def c17(t):
    """Keys valid in the product and in every model."""
    p = t.pairs
    models = p.select("key", F.inline(F.array(F.struct(F.lit("a").alias("model"), F.col("valid_a").alias("valid")), F.struct(F.lit("b").alias("model"), F.col("valid_b").alias("valid")))))
    keys = joins.common_support(models, "key", "model", F.col("valid"), 2)
    return p.filter("eligible").join(keys, "key", "left_semi").groupBy("task").agg(count())


@query("C18_label_pack_join", f"""WITH k AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, CASE WHEN l_linenumber % 2 = 0 THEN 'sm' ELSE 'et' END AS variable, l_returnflag AS source, l_quantity AS value FROM lineitem WHERE l_linenumber <= 2),
 w AS (SELECT sample_id, max(CASE WHEN variable='sm' THEN value END) AS sm, count(DISTINCT CASE WHEN variable='sm' THEN source END) AS sn, max(CASE WHEN variable='et' THEN value END) AS et, count(DISTINCT CASE WHEN variable='et' THEN source END) AS en FROM k GROUP BY sample_id)
 SELECT m.sample_id, {R('CASE WHEN sn = 1 THEN sm END')} AS sm, coalesce(sn,0) = 1 AS sm_valid, {R('CASE WHEN en = 1 THEN et END')} AS et, coalesce(en,0) = 1 AS et_valid FROM @manifest m LEFT JOIN w ON m.sample_id = w.sample_id""")
def c18(t):
    """Labels from packs; missing ones are masked and a variable needs exactly one source."""
    k = t.lineitem.filter("l_linenumber <= 2").select(F.col("l_orderkey").cast("string").alias("sample_id"), F.when(F.col("l_linenumber") % 2 == 0, "sm").otherwise("et").alias("variable"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("value"))
    out = joins.pack_labels(t.manifest.select("sample_id"), k, "sample_id", ["sm", "et"])
    return out.select("sample_id", r6("sm").alias("sm"), "sm_valid", r6("et").alias("et"), "et_valid")


@query("C19_reuse_join", "SELECT m.sample_id, o_orderpriority AS stored FROM @manifest m WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0")
def c19(t):
    """Prior inputs of the same id on the same grid within tolerance."""
    m = t.manifest
    prior = m.filter("o_orderkey % 2 = 0").select("sample_id", (F.col("x") + F.when(F.col("o_orderkey") % 3 == 0, 1e-3).otherwise(1e-9)).alias("x"), "y", F.col("o_orderpriority").alias("stored"))
    return joins.reuse(m.select("sample_id", "x", "y"), prior, "sample_id", ["x", "y"]).select("sample_id", "stored")


@query("C20_scene_pair_match", """WITH a AS (SELECT p_partkey, 'L1_' || p_brand || '_' || CAST(p_size AS VARCHAR) AS id, p_size % 4 AS tm FROM part), b AS (SELECT DISTINCT 'L2_' || p_brand || '_' || CAST(p_size AS VARCHAR) AS id2, p_size % 4 AS tm2 FROM part WHERE p_size % 3 <> 0)
 SELECT p_partkey, id2 FROM a JOIN b ON id2 = replace(id, 'L1_', 'L2_') AND tm = tm2""")
def c20(t):
    """Level 1 and level 2 scenes matched by the rewritten id at equal times."""
    name = F.concat(F.lit("L1_"), "p_brand", F.lit("_"), F.col("p_size").cast("string"))
    a = t.part.select("p_partkey", F.regexp_replace(name, "^L1_", "L2_").alias("id2"), (F.col("p_size") % 4).alias("tm"))
    b = t.part.filter("p_size % 3 <> 0").select(F.regexp_replace(name, "^L1_", "L2_").alias("id2"), (F.col("p_size") % 4).alias("tm")).distinct()
    return a.join(b, ["id2", "tm"]).select("p_partkey", "id2")


@query("C21_overlap_source", """WITH c AS (SELECT DISTINCT l_suppkey AS block, l_returnflag AS source, l_orderkey % 64 AS cell, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS rk FROM lineitem),
 f AS (SELECT block, source, rk FROM c GROUP BY ALL HAVING count(DISTINCT cell) = 64) SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS block, (SELECT source FROM f WHERE f.block = s_suppkey ORDER BY rk LIMIT 1) AS source FROM supplier""")
def c21(t):
    """The first source that covers the whole block."""
    c = t.lineitem.select(F.col("l_suppkey").alias("block"), F.col("l_returnflag").alias("source"), (F.col("l_orderkey") % 64).alias("cell"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END").alias("rk"))
    b = t.supplier.select(F.col("s_suppkey").alias("block")).distinct()
    return joins.covering_source(b, c, "block", "source", "rk", 64)


@query("C22_product_row", f"""SELECT key, task, {R('CASE WHEN task = chr(115)||chr(109) THEN product/60 ELSE product/10 END')} AS product_value, CASE WHEN year(day) < 1996 THEN 'before_availability' WHEN task = 'sm' AND l_returnflag = 'R' THEN 'product_quality' WHEN task = 'et' AND target > 45 THEN 'impure_cell' END AS reason FROM @pairs p""")
def c22(t):
    """Task-specific pairing results in one table; eligible when no reason remains."""
    p = t.pairs
    early = F.year("day") < 1996
    sm = p.filter("task = 'sm'").select("key", "task", (F.col("product") / 60).alias("v"), F.when(early, "before_availability").when(F.col("l_returnflag") == "R", "product_quality").alias("reason"))
    et = p.filter("task = 'et'").select("key", "task", (F.col("product") / 10).alias("v"), F.when(early, "before_availability").when(F.col("target") > 45, "impure_cell").alias("reason"))
    return sets.stack(sm, et).select("key", "task", r6("v").alias("product_value"), "reason")


# --- D ------------------------------------------------------------------------------------------

@query("D8_group_counts", """SELECT split, frequency_bin, climate_class, count(*) AS n, CAST(sum(valid_sm) AS BIGINT) AS sm, CAST(sum(valid_et) AS BIGINT) AS et FROM @candidates c GROUP BY GROUPING SETS ((split, frequency_bin), (split, climate_class), (split))""")
def d8(t):
    """Crosstabs of the manifest in one pass."""
    c = t.candidates
    out = c.groupingSets([["split", "frequency_bin"], ["split", "climate_class"], ["split"]], "split", "frequency_bin", "climate_class").agg(count(), F.sum("valid_sm").alias("sm"), F.sum("valid_et").alias("et"))
    return out.select("split", "frequency_bin", "climate_class", "n", "sm", "et")


_CAP = """WITH RECURSIVE d AS (SELECT g, s, b, t, row_number() OVER (PARTITION BY g, s, b ORDER BY t) AS i FROM (SELECT DISTINCT physical_group_id AS g, {split} AS s, frequency_bin AS b, target_time AS t FROM @candidates c)),
 w AS (SELECT g, s, b, min(t) AS t, 1 AS n FROM d GROUP BY g, s, b UNION ALL SELECT w.g, w.s, w.b, (SELECT min(d.t) FROM d WHERE d.g = w.g AND d.s = w.s AND d.b = w.b AND d.t >= w.t + 30) AS t, n + 1 FROM w WHERE EXISTS (SELECT 1 FROM d WHERE d.g = w.g AND d.s = w.s AND d.b = w.b AND d.t >= w.t + 30))"""


@query("D9_availability", _CAP.format(split="split") + """, cap AS (SELECT s, b, g, max(n) AS c FROM w GROUP BY s, b, g), base AS (SELECT split, frequency_bin, count(DISTINCT physical_group_id) AS st, count(DISTINCT (physical_group_id, target_time)) AS sw FROM @candidates c GROUP BY GROUPING SETS ((split, frequency_bin), (frequency_bin))),
 caps AS (SELECT s, b, sum(c) AS c FROM cap GROUP BY GROUPING SETS ((s, b), (b)))
 SELECT x.split, x.bin AS frequency_bin, CAST(coalesce(st, 0) AS BIGINT) AS physical_stations, CAST(coalesce(sw,0) AS BIGINT) AS station_windows, CAST(coalesce(c,0) AS BIGINT) AS capacity_30d FROM (SELECT * FROM (VALUES ('all'),('train'),('validation'),('test')) v(split), (SELECT CAST(i AS INTEGER) AS bin FROM range(0,7) r(i)) q) x
 LEFT JOIN base ON coalesce(base.split,'all') = x.split AND base.frequency_bin = x.bin LEFT JOIN caps ON coalesce(caps.s,'all') = x.split AND caps.b = x.bin""")
def d9(t):
    """Stations, station windows and spaced capacity per split and bin; empty cells stay as zeros."""
    from landtally.operators.availability import availability

    return availability(t.candidates, ["physical_group_id"], "target_time", 30)


@query("D10_spaced_capacity", _CAP.format(split="''") + " SELECT g AS physical_group_id, CAST(max(n) AS BIGINT) AS capacity FROM w GROUP BY g")
def d10(t):
    """Greatest number of dates at least thirty days apart."""
    return draws.spaced_capacity(t.candidates, ["physical_group_id"], "target_time")


@query("D12_map_sum", """SELECT label, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS samples FROM (SELECT 'rare' AS label, rare AS v FROM @manifest m UNION ALL SELECT 'common', common FROM @manifest m) x GROUP BY label""")
def d12(t):
    """Key-wise sums of per-row count maps."""
    m = t.manifest.select(F.create_map(F.lit("rare"), F.col("rare"), F.lit("common"), F.col("common")).alias("counts"))
    return m.select(F.explode("counts").alias("label", "v")).groupBy("label").agg(F.sum("v").alias("total"), isum(F.col("v") > 0, "samples"))


@query("D13_distinct_value_check", "SELECT user_id, count(*) AS rows FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def d13(t):
    """Groups with more than one attribute value."""
    return checks.conflicts(t.events, ["user_id"], "event_type").select("user_id", "rows")


@query("D14_moments_merge", f"""SELECT event_type, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM events GROUP BY event_type""")
def d14(t):
    """Moments of daily parts merged into one."""
    parts = metrics.moments(t.events.withColumn("part", F.to_date("ts")), ["event_type", "part"], "value")
    out = metrics.merge_moments(parts.drop("std", "reason"), ["event_type"])
    return out.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("D15_moments_from_sums", f"SELECT l_returnflag, {R('avg(l_quantity)')} AS mean, {R('stddev_pop(l_quantity)')} AS std FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1")
def d15(t):
    """Mean and deviation from three sums over selected ids."""
    q = F.col("l_quantity")
    s = t.lineitem.filter("l_orderkey % 2 = 0").groupBy("l_returnflag").agg(F.count(q).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("ss"))
    mean, std = metrics.moments_from_sums(F.col("n"), F.col("s"), F.col("ss"))
    return s.select("l_returnflag", r6(mean).alias("mean"), r6(std).alias("std"))


@query("D16_subset_description", """SELECT split, count(*) AS windows, count(DISTINCT spatial_group_id) AS spatial_groups, count(DISTINCT frequency_bin) AS strata, count(DISTINCT year) AS years, CAST(sum(CASE WHEN rare > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rare_windows, CAST(sum(rare) AS BIGINT) AS rare_total FROM @manifest m GROUP BY split""")
def d16(t):
    """Exposure and support of each split."""
    return t.manifest.groupBy("split").agg(count("windows"), F.countDistinct("spatial_group_id").alias("spatial_groups"), F.countDistinct("frequency_bin").alias("strata"), F.countDistinct("year").alias("years"), isum(F.col("rare") > 0, "rare_windows"), F.sum("rare").alias("rare_total"))


@query("D17_station_rollup", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT CASE WHEN c_acctbal < 0 THEN 'negative ' || c_mktsegment END, ';' ORDER BY CASE WHEN c_acctbal < 0 THEN 'negative ' || c_mktsegment END) AS issues FROM customer GROUP BY 1")
def d17(t):
    """One row per station with its sorted, distinct issues."""
    issue = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("negative "), "c_mktsegment"))
    small = t.customer.groupBy("c_nationkey", "c_mktsegment", issue.alias("issue")).agg(count())
    return small.groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments"), F.nullif(F.array_join(F.array_sort(F.collect_set("issue")), ";"), F.lit("")).alias("issues"))


@query("D18_site_list", "SELECT observation_date, string_agg(DISTINCT site_name, ';' ORDER BY site_name) AS sites FROM @points p GROUP BY 1")
def d18(t):
    """Sorted unique sites per window."""
    return t.points.select("observation_date", "site_name").distinct().groupBy("observation_date").agg(F.array_join(F.array_sort(F.collect_list("site_name")), ";").alias("sites"))


@query("D19_strata_histogram", "SELECT CAST(p_size AS INTEGER) AS stratum, CAST(sum(p_partkey) AS BIGINT) AS population FROM part WHERE p_size BETWEEN 1 AND 30 AND p_brand <> 'Brand#7' GROUP BY 1")
def d19(t):
    """Histogram keys normalised, invalid ones dropped, populations summed."""
    key = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_brand") == "Brand#7", "x").otherwise(".0"))
    h = t.part.select(F.trim(key).try_cast("double").alias("k"), "p_partkey")
    return h.filter(F.col("k").between(1, 30)).groupBy(F.col("k").cast("int").alias("stratum")).agg(F.sum("p_partkey").alias("population"))


@query("D23_aggregate_summary", f"""SELECT source_priority, count(*) AS windows, count(DISTINCT physical_group_id) AS stations, count(DISTINCT (physical_group_id, target_time)) AS unique_windows, CAST(sum(CASE WHEN operator_ready THEN 0 ELSE 1 END) AS BIGINT) AS failures, count(*) = CAST(sum(CASE WHEN quantity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS complete FROM @candidates c GROUP BY 1""")
def d23(t):
    """Totals, failures and completeness per source."""
    return t.candidates.groupBy("source_priority").agg(count("windows"), F.countDistinct("physical_group_id").alias("stations"), F.countDistinct("physical_group_id", "target_time").alias("unique_windows"), isum(~F.col("operator_ready"), "failures"),
        (F.count(F.lit(1)) == F.sum((F.col("quantity") > 0).cast("int"))).alias("complete"))


@query("D24_sampling_mass", f"""WITH g AS (SELECT target, frequency_bin, physical_group_id, sum(quantity) AS q FROM @candidates c GROUP BY ALL), a AS (SELECT target, sum(q) AS t FROM g GROUP BY 1), m AS (SELECT target, physical_group_id, sum(q) AS q FROM g GROUP BY ALL)
 SELECT g.target, frequency_bin, {R('sum(q)/min(t)')} AS mass, {R('(SELECT max(m.q) FROM m WHERE m.target = g.target)/min(t)')} AS largest_group FROM g JOIN a ON g.target = a.target GROUP BY g.target, frequency_bin""")
def d24(t):
    """Mass per source and bin, and the largest group's share."""
    g = t.candidates.groupBy("target", "frequency_bin", "physical_group_id").agg(F.sum("quantity").alias("q"))
    total = g.groupBy("target", "physical_group_id").agg(F.sum("q").alias("q")).groupBy("target").agg(F.sum("q").alias("t"), F.max("q").alias("m"))
    out = g.groupBy("target", "frequency_bin").agg(F.sum("q").alias("q")).join(total, "target")
    return out.select("target", "frequency_bin", r6(F.col("q") / F.col("t")).alias("mass"), r6(F.col("m") / F.col("t")).alias("largest_group"))


@query("D25_availability_patterns", """SELECT split, pattern, count(*) AS n, count(DISTINCT climate_class) AS climates, count(DISTINCT month) AS months FROM (SELECT *, concat(CASE WHEN rare > 0 THEN 'R' ELSE '-' END, CASE WHEN common > 0 THEN 'C' ELSE '-' END) AS pattern FROM @manifest m) x GROUP BY 1, 2""")
def d25(t):
    """Label-availability patterns per split."""
    p = F.concat(*[F.when(F.col(c) > 0, k).otherwise("-") for c, k in (("rare", "R"), ("common", "C"))])
    return t.manifest.groupBy("split", p.alias("pattern")).agg(count(), F.countDistinct("climate_class").alias("climates"), F.countDistinct("month").alias("months"))


# --- E ------------------------------------------------------------------------------------------

_DIV = """h AS (SELECT *, sha256('42:' || sample_id) AS order_hash, CAST(year(target_time) AS VARCHAR) || ':' || CAST((month(target_time)-1)//3 AS VARCHAR) AS season FROM @manifest m),
 v AS (SELECT *, row_number() OVER (PARTITION BY spatial_group_id, season ORDER BY order_hash) AS season_visit FROM h), u AS (SELECT *, row_number() OVER (PARTITION BY spatial_group_id ORDER BY season_visit, order_hash) AS spatial_visit FROM v)"""


@query("E1_diverse_order", f"WITH {_DIV} SELECT sample_id, order_hash, season_visit, spatial_visit FROM u")
def e1(t):
    """Visit numbers that spread groups and seasons."""
    out = draws.diverse_visits(t.manifest, 42, "spatial_group_id")
    return out.select("sample_id", "order_hash", "season_visit", "spatial_visit")


@query("E2_preferred_duplicate", """SELECT physical_group_id, strftime(target_time, '%Y-%m-%d') AS target_time, first(candidate_id ORDER BY NOT operator_ready, source_priority, candidate_id) AS candidate_id, max(valid_sm) AS valid_sm, max(valid_et) AS valid_et, count(*) AS copies FROM @candidates c GROUP BY physical_group_id, c.target_time""")
def e2(t):
    """Preferred row of each station window, flags OR-ed over all its rows."""
    c = t.candidates.select("physical_group_id", "target_time", "candidate_id", "operator_ready", "source_priority", "valid_sm", "valid_et")
    out = sets.preferred(c, ["physical_group_id", "target_time"], [~F.col("operator_ready"), F.col("source_priority"), F.col("candidate_id")], ["valid_sm", "valid_et"])
    return out.select("physical_group_id", day_text("target_time").alias("target_time"), "candidate_id", "valid_sm", "valid_et", "copies")


@query("E3_preferred_observation", """WITH r AS (SELECT physical_group_id, target_time, target, candidate_id, row_number() OVER (PARTITION BY physical_group_id, target_time, target ORDER BY source_priority, candidate_id) AS rn FROM @candidates c)
 SELECT target, candidate_id FROM r WHERE target <> 'et' OR rn = 1""")
def e3(t):
    """Every soil-moisture sensor, only the best ET alternative."""
    c = t.candidates.select("physical_group_id", "target_time", "target", "candidate_id", "source_priority")
    et = sets.preferred(c.filter("target = 'et'"), ["physical_group_id", "target_time", "target"], [F.col("source_priority"), F.col("candidate_id")])
    return c.filter("target <> 'et'").select("target", "candidate_id").unionByName(et.select("target", "candidate_id"))


_SC = "SELECT l_suppkey AS place, CAST(dayofyear(l_shipdate) // 74 AS INT) AS slot, {ep} AS t_s, 867000000 + (l_suppkey % 5) * 20000000 AS target_s, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS scene, l_linenumber % 3 AS orbit FROM {t}"


@query("E4_scene_choice", f"""WITH s AS ({_SC.format(ep='CAST(epoch(l_shipdate) AS BIGINT)', t='lineitem')}), n AS (SELECT place, slot, scene, t_s, row_number() OVER (PARTITION BY place, slot ORDER BY abs(t_s-target_s), -t_s, scene) AS rn FROM s),
 a AS (SELECT place, orbit FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY abs(t_s-target_s), -t_s, scene) AS rn FROM s) x WHERE rn = 1),
 b AS (SELECT s.place, slot, scene, t_s, row_number() OVER (PARTITION BY s.place, slot ORDER BY abs(t_s-target_s), -t_s, scene) AS rn FROM s JOIN a ON s.place = a.place AND s.orbit = a.orbit)
 SELECT 'nearest' AS rule, place, slot, scene, t_s FROM n WHERE rn = 1 UNION ALL SELECT 'anchored', place, slot, scene, t_s FROM b WHERE rn = 1""")
def e4(t):
    """Nearest scene per slot, and per slot within the anchored orbit."""
    s = t.sql(_SC.format(ep="unix_seconds(CAST(l_shipdate AS TIMESTAMP))", t="$lineitem").replace("// 74", "div 74"))
    a = pixels.nearest_scenes(s, ["place", "slot"], "t_s", "target_s", "scene").withColumn("rule", F.lit("nearest"))
    b = pixels.anchored_orbit_scenes(s, ["place"], "slot", "t_s", "target_s", "scene", "orbit").withColumn("rule", F.lit("anchored"))
    return a.unionByName(b).select("rule", "place", "slot", "scene", "t_s")


def _carried_sql() -> str:
    base = _SC.format(ep='CAST(epoch(l_shipdate) AS BIGINT)', t='lineitem')
    parts, union = [f"s AS ({base})", "o5 AS (SELECT DISTINCT place, CAST(NULL AS INTEGER) AS orbit FROM s)"], []
    for k in (4, 3, 2, 1, 0):
        parts.append(f"""c{k} AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.place ORDER BY abs(t_s-target_s), -t_s, scene) AS rn FROM s JOIN o{k + 1} o ON o.place = s.place WHERE s.slot = {k} AND (o.orbit IS NULL OR o.orbit = s.orbit)) x WHERE rn = 1)""")
        parts.append(f"o{k} AS (SELECT o.place, coalesce(c.orbit, o.orbit) AS orbit FROM o{k + 1} o LEFT JOIN c{k} c ON c.place = o.place)")
        union.append(f"SELECT place, slot, scene, orbit FROM c{k}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(union)


@query("E4_carried_orbit", _carried_sql())
def e4b(t):
    """Slots from last to first, each choice passing its orbit on."""
    s = t.sql(_SC.format(ep="unix_seconds(CAST(l_shipdate AS TIMESTAMP))", t="$lineitem").replace("// 74", "div 74"))
    return pixels.carried_orbit_scenes(s, ["place"], "slot", 5, "t_s", "target_s", "scene", "orbit").select("place", "slot", "scene", "orbit")


@query("E7_latest_per_modality", "SELECT user_id, event_type, max(event_id) AS latest FROM events GROUP BY 1, 2")
def e7(t):
    """Latest row per modality."""
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("E9_head_per_group", """WITH h AS (SELECT *, sha256('[7, ' || chr(34) || candidate_id || chr(34) || ']') AS hs FROM @candidates c), a AS (SELECT *, row_number() OVER (PARTITION BY frequency_bin, landcover, physical_group_id ORDER BY hs) AS r1 FROM h),
 b AS (SELECT *, row_number() OVER (PARTITION BY frequency_bin, landcover ORDER BY hs) AS r2 FROM a WHERE r1 <= 2) SELECT frequency_bin, landcover, physical_group_id, candidate_id FROM b WHERE r2 <= 5""")
def e9(t):
    """Two per site, then five per stratum, in hash order."""
    return draws.head_per_group(t.candidates, ["physical_group_id"], ["frequency_bin", "landcover"], 2, 5, 7, "candidate_id").select("frequency_bin", "landcover", "physical_group_id", "candidate_id")


@query("E10_equal_bin_head", """WITH r AS (SELECT candidate_id, frequency_bin, row_number() OVER (PARTITION BY frequency_bin ORDER BY sha256('[7, ' || chr(34) || candidate_id || chr(34) || ']')) AS rk FROM @candidates c)
 SELECT frequency_bin, candidate_id FROM r WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM @candidates c GROUP BY frequency_bin) x)""")
def e10(t):
    """As many rows of each bin as the smallest bin holds."""
    c = t.candidates.select("frequency_bin", "candidate_id").withColumn("h", K.hash_rank(7, K.quoted(F.col("candidate_id"))))
    return draws.equal_bin_head_by_hash(c, "frequency_bin", "h").select("frequency_bin", "candidate_id")


@query("E11_latest_composite", f"""WITH s AS (SELECT p_partkey AS scene, CAST(DATE '2024-01-01' + CAST(p_partkey % 45 AS INTEGER) AS DATE) AS a, p_size AS cloud FROM part), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
 j AS (SELECT day, scene, a, row_number() OVER (PARTITION BY day ORDER BY a DESC, cloud, scene) AS rn FROM d JOIN s ON a <= day AND a + 8 > day) SELECT {D('day')} AS day, scene, {D('a')} AS scene_start, {D('CAST(a + 8 AS DATE)')} AS scene_end FROM j WHERE rn = 1""")
def e11(t):
    """Newest composite whose interval contains the target; least cloud on the same day."""
    from landtally.operators.availability import latest_composite

    s = t.part.select(F.col("p_partkey").alias("scene"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 45).cast("int")).alias("start"), F.col("p_size").alias("cloud"))
    d = t.events.select(F.to_date("ts").alias("day")).distinct()
    out = latest_composite(d, s, "day", "start", 8, ["cloud", "scene"])
    return out.select(day_text("day").alias("day"), "scene", day_text("start").alias("scene_start"), day_text(F.date_add("start", 8)).alias("scene_end"))


# --- G ------------------------------------------------------------------------------------------

@query("G1_union_by_name", "SELECT src, count(*) AS n, count(extra) AS extras FROM (SELECT 'c' AS src, c_acctbal AS extra FROM customer UNION ALL SELECT 's', NULL FROM supplier) x GROUP BY src")
def g1(t):
    """Columns a table lacks become NULL."""
    c = t.customer.select(F.lit("c").alias("src"), F.col("c_acctbal").alias("extra"))
    return sets.stack(c, t.supplier.select(F.lit("s").alias("src"))).groupBy("src").agg(count(), F.count("extra").alias("extras"))


@query("G2_dedup_union", """SELECT station, start_s, first(src ORDER BY pr) AS source FROM (SELECT station, start_s, 'b' AS src, 1 AS pr FROM @flux f WHERE qc < 2 UNION ALL SELECT station, start_s, 'a', 0 FROM @flux f WHERE start_s % 5400 = 0) x GROUP BY 1, 2""")
def g2(t):
    """The better source wins on equal starts."""
    f = t.flux.select("station", "start_s", "qc")
    u = sets.stack(f.filter("qc < 2").withColumn("source", F.lit("b")).withColumn("pr", F.lit(1)), f.filter("start_s % 5400 = 0").withColumn("source", F.lit("a")).withColumn("pr", F.lit(0)))
    return sets.preferred(u, ["station", "start_s"], [F.col("pr")]).select("station", "start_s", "source")


@query("G3_manifest_merge", """WITH u AS (SELECT sample_id, 0 AS source_order, o_custkey, target_time FROM @manifest m WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b' || sample_id, 1, o_custkey, target_time FROM @manifest m WHERE o_orderkey % 3 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, target_time ORDER BY source_order, sample_id) AS rn FROM u) SELECT sample_id, source_order, CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM r""")
def g3(t):
    """Manifests merged by physical identity; earlier sources win and every drop is reported."""
    m = t.manifest.select("sample_id", "o_orderkey", F.col("o_custkey").cast("string").alias("place"), day_text("target_time").alias("target_time"))
    kept, report = sets.merge_manifests([m.filter("o_orderkey % 2 = 0"), m.filter("o_orderkey % 3 = 0").withColumn("sample_id", F.concat(F.lit("b"), "sample_id"))], ["place", "target_time"])
    return kept.select("sample_id", "source_order", F.lit("kept").alias("status")).unionByName(report.select("sample_id", "source_order", F.col("issue").alias("status")))


@query("G4_id_set_checks", """SELECT sample_id, 'right' AS missing_from FROM @manifest m WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 5 <> 1 UNION ALL SELECT sample_id, 'left' FROM @manifest m WHERE (o_orderkey % 5 = 0 OR o_orderkey % 5 = 1) AND o_orderkey % 7 <> 0""")
def g4(t):
    """Ids on one side only."""
    m = t.manifest
    return checks.set_difference(m.filter("o_orderkey % 7 = 0"), m.filter("o_orderkey % 5 in (0, 1)"), "sample_id")


@query("G5_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def g5(t):
    """Keys present for every model."""
    return joins.common_support(t.lineitem, "l_partkey", "l_returnflag", F.lit(True), 3)


@query("G6_ledger_replay", """WITH l AS (SELECT l_suppkey AS id, l_linestatus AS status, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS o FROM lineitem WHERE l_orderkey % 2 = 0 AND l_suppkey % 3 <> 0), r AS (SELECT l_suppkey AS id, l_linestatus AS status, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS o FROM lineitem WHERE l_orderkey % 5 = 0),
 w AS (SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)) SELECT id, arg_max(status, o) AS status, count(*) AS attempts FROM w GROUP BY id""")
def g6(t):
    """Missing records appended, then the last status of each id."""
    x = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("status"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("o"), "l_orderkey")
    return sets.replay(x.filter("l_orderkey % 2 = 0 and id % 3 <> 0"), x.filter("l_orderkey % 5 = 0"), "id", "o", "status")


# --- L ------------------------------------------------------------------------------------------

@query("L1_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def l1(t):
    """Repeated keys."""
    return checks.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("L2_manifest_audit", f"""SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN sampling_group % 7 <> frequency_bin % 7 THEN 'group_bin' END, CASE WHEN dayofyear(target_time) % 8 <> 1 THEN 'calendar' END,
  CASE WHEN split <> {SPLIT(f"sha256('[42, ' || chr(34) || block || chr(34) || ']')")} THEN 'split' END, CASE WHEN NOT (least(least((lon+180)%5, 5-(lon+180)%5)*111320*cos(radians(lat)), least((lat+90)%5, 5-(lat+90)%5)*111320) >= 35000) THEN 'edge' END]) AS violation FROM @manifest m) x WHERE violation IS NOT NULL GROUP BY violation
 UNION ALL SELECT 'quota', count(*) FROM (SELECT sampling_group FROM @manifest m GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM orders)//8 + CASE WHEN sampling_group < (SELECT count(*) FROM orders) % 8 THEN 1 ELSE 0 END) q""")
def l2(t):
    """Group, calendar, split and edge rules, and quota shortfalls."""
    m = t.manifest
    rules = {"group_bin": F.col("sampling_group") % 7 == F.col("frequency_bin") % 7, "calendar": F.dayofyear("target_time") % 8 == 1,
             "split": F.col("split") == K.geographic_split(F.col("lon"), F.col("lat"), 42), "edge": K.inside_split_block(F.col("lon"), F.col("lat"))}
    rows = checks.violations(m, "sample_id", rules).groupBy("violation").agg(count())
    total = m.agg(F.count(F.lit(1)).alias("_t"))
    groups = m.select("sampling_group").distinct().withColumn("_t", total.scalar())
    quotas = groups.select("sampling_group", bins.even_quota(F.col("_t"), 8, F.col("sampling_group")).alias("quota"))
    short = checks.quota_shortfall(m, "sampling_group", quotas).agg(count()).select(F.lit("quota").alias("violation"), "n")
    return rows.unionByName(short)


@query("L3_array_audit", """SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT (row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 6) THEN 'shape' END, CASE WHEN abs(value) > 0.3 THEN 'range' END, CASE WHEN (abs(value) > 0.05) <> valid THEN 'mask' END]) AS violation FROM @pixels p) x WHERE violation IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'sum', count(*) FROM (SELECT vec_id FROM @probabilities q GROUP BY 1 HAVING abs(sum(p) - 1) > 1e-6) s""")
def l3(t):
    """Shape, range, mask and sum rules over arrays."""
    rules = {"shape": F.col("row").between(0, 7) & F.col("col").between(0, 6), "range": F.abs("value") <= 0.3, "mask": (F.abs("value") > 0.05) == F.col("valid")}
    rows = checks.violations(t.pixels, "tile", rules).groupBy("violation").agg(count())
    sums = t.probabilities.groupBy("vec_id").agg(F.sum("p").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-6)
    return rows.unionByName(sums.agg(count()).select(F.lit("sum").alias("violation"), "n"))


@query("L4_observation_audit", """SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT (value BETWEEN 0 AND 0.5) THEN 'bounds' END, CASE WHEN t_s < 1704067200 OR t_s >= 1706400000 THEN 'window' END, CASE WHEN NOT good THEN 'quality' END]) AS violation FROM @sensor s) x WHERE violation IS NOT NULL GROUP BY 1""")
def l4(t):
    """Value bounds, time support and quality of observations."""
    rules = {"bounds": F.col("value").between(0, 0.5), "window": (F.col("t_s") >= 1704067200) & (F.col("t_s") < 1706400000), "quality": F.col("good")}
    return checks.violations(t.sensor, "sensor", rules).groupBy("violation").agg(count())


@query("L5_conflicting_labels", "SELECT cell, count(*) AS rows FROM @points p GROUP BY cell HAVING count(DISTINCT cover_class) > 1")
def l5(t):
    """Same cell, different class."""
    return checks.conflicts(t.points, ["cell"], "cover_class").select("cell", "rows")


@query("L7_selection_audit", """WITH s AS (SELECT candidate_id, CASE WHEN quantity = 7 THEN 8 ELSE quantity END AS q, physical_group_id, target_time FROM @candidates c WHERE cohort = 1), d AS (SELECT DISTINCT physical_group_id, target_time FROM s), n AS (SELECT *, lead(target_time) OVER (PARTITION BY physical_group_id ORDER BY target_time) - target_time AS gap FROM d)
 SELECT 'changed' AS violation, count(*) AS n FROM s JOIN @candidates c USING (candidate_id) WHERE q <> quantity UNION ALL SELECT 'date_gap', count(*) FROM n WHERE gap < 30 UNION ALL SELECT 'crossing', count(*) FROM (SELECT physical_group_id FROM @candidates c GROUP BY 1 HAVING count(DISTINCT split) > 1) x""")
def l7(t):
    """Changed rows, crossing stations and close dates of a selection."""
    c = t.candidates
    cols = ["candidate_id", "quantity", "physical_group_id", "target_time", "split"]
    s = c.filter("cohort = 1").select(cols).withColumn("quantity", F.when(F.col("quantity") == 7, 8.0).otherwise(F.col("quantity")))
    changed = checks.changed_rows(s, c.select(cols)).agg(count()).withColumn("violation", F.lit("changed"))
    gaps = checks.close_dates(s, ["physical_group_id"], "target_time", 30).agg(count()).withColumn("violation", F.lit("date_gap"))
    cross = checks.crossing_groups(c, "physical_group_id", "split").agg(count()).withColumn("violation", F.lit("crossing"))
    return changed.unionByName(gaps).unionByName(cross).select("violation", "n")


@query("L8_label_drift", f"SELECT key, {R('target')} AS left_value, {R('target * 1.001')} AS right_value FROM @pairs p WHERE valid_a AND l_partkey % 20 = 0")
def l8(t):
    """Labels of the same key that are not close."""
    p = t.pairs
    other = p.filter("valid_a").withColumn("target", F.col("target") * F.when(F.col("l_partkey") % 20 == 0, 1.001).otherwise(1.0 + 1e-9))
    out = joins.label_drift(p, other, ["key"], "target")
    return out.select("key", r6("left_value").alias("left_value"), r6("right_value").alias("right_value"))


@query("L9_production_audit", """WITH w AS (SELECT tile, sum(abs(value)) AS s, min(abs(value)) AS lo, count(*) AS n, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS v FROM @pixels p GROUP BY tile)
 SELECT tile, violation FROM (SELECT tile, unnest([CASE WHEN NOT (s BETWEEN 6 AND 7) THEN 'weight_sum' END, CASE WHEN v < 52 THEN 'support' END, CASE WHEN n <> 64 THEN 'cells' END]) AS violation FROM w) x WHERE violation IS NOT NULL""")
def l9(t):
    """Weights, support and cell counts re-verified per observation."""
    w = t.pixels.groupBy("tile").agg(F.sum(F.abs("value")).alias("s"), count(), F.sum(F.col("valid").cast("int")).alias("v"))
    return checks.violations(w, "tile", {"weight_sum": F.col("s").between(6, 7), "support": F.col("v") >= 52, "cells": F.col("n") == 64})


@query("L10_cover_point_audit", """WITH p AS (SELECT point_id, cell, cover_class, site_name, CAST(point_id % 40 AS INTEGER) AS row FROM @points p) SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN row <> point_id % 40 THEN 'row' END, CASE WHEN cover_class NOT IN (0,1) THEN 'class' END, CASE WHEN site_name NOT IN ('en','fr','de') THEN 'domain' END]) AS violation FROM p) x WHERE violation IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'repeated', count(*) FROM (SELECT cell FROM p GROUP BY cell HAVING count(*) > 3) y""")
def l10(t):
    """Position, class and domain rules of human points, and repeated cells."""
    p = t.points.withColumn("row", (F.col("point_id") % 40).cast("int"))
    rules = {"row": F.col("row") == F.col("point_id") % 40, "class": F.col("cover_class").isin(0, 1), "domain": F.col("site_name").isin("en", "fr", "de")}
    rows = checks.violations(p, "point_id", rules).groupBy("violation").agg(count())
    again = checks.duplicates(p, ["cell"]).filter("copies > 3").agg(count()).select(F.lit("repeated").alias("violation"), "n")
    return rows.unionByName(again)


@query("L11_split_leakage", """SELECT 'crossing' AS violation, count(*) AS n FROM (SELECT spatial_group_id FROM @manifest m GROUP BY 1 HAVING count(DISTINCT split) > 1) a UNION ALL SELECT 'locked', count(DISTINCT spatial_group_id) FROM @manifest m WHERE CAST(spatial_group_id AS BIGINT) % 10 = 0 AND split <> 'train'
 UNION ALL SELECT 'overlap', count(DISTINCT o_custkey) FROM @manifest m WHERE split = 'test' AND o_custkey IN (SELECT o_custkey FROM @manifest k WHERE split = 'train')""")
def l11(t):
    """Groups that cross splits, locked groups outside train, and evaluation ids seen in train."""
    m = t.manifest
    a = checks.crossing_groups(m, "spatial_group_id", "split").agg(count()).withColumn("violation", F.lit("crossing"))
    b = m.filter("cast(spatial_group_id as bigint) % 10 = 0 and split <> 'train'").agg(F.countDistinct("spatial_group_id").alias("n")).withColumn("violation", F.lit("locked"))
    seen = m.filter("split = 'train'").select("o_custkey").distinct()
    c = m.filter("split = 'test'").join(seen, "o_custkey", "left_semi").agg(F.countDistinct("o_custkey").alias("n")).withColumn("violation", F.lit("overlap"))
    return a.unionByName(b).unionByName(c).select("violation", "n")


@query("L12_field_closure", """SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT (w BETWEEN 0 AND 0.5) THEN 'range' END, CASE WHEN NOT (s BETWEEN 0.99 AND 1.01) THEN 'closure' END, CASE WHEN (w > 0.01) <> (i > 0.01) THEN 'mask' END]) AS violation FROM (SELECT vec_id, max(CASE WHEN pos=0 THEN p END) AS w, max(CASE WHEN pos=8 THEN p END) AS i, sum(CASE WHEN pos < 8 OR p > 0.02 THEN p ELSE 0 END) AS s FROM @probabilities q GROUP BY vec_id) f) x WHERE violation IS NOT NULL GROUP BY 1""")
def l12(t):
    """Range, closure and mask agreement of predicted fractions."""
    p = F.col("p")
    f = t.probabilities.groupBy("vec_id").agg(F.max(F.when(F.col("pos") == 0, p)).alias("w"), F.max(F.when(F.col("pos") == 8, p)).alias("i"), F.sum(F.when((F.col("pos") < 8) | (p > 0.02), p).otherwise(0.0)).alias("s"))
    rules = {"range": F.col("w").between(0, 0.5), "closure": F.col("s").between(0.99, 1.01), "mask": (F.col("w") > 0.01) == (F.col("i") > 0.01)}
    return checks.violations(f, "vec_id", rules).groupBy("violation").agg(count())


@query("L13_pack_audit", """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), k AS (SELECT DISTINCT CAST(round_even(j * (n - 1) / 49.0, 0) AS BIGINT) AS i FROM (SELECT max(n) AS n FROM r) a, range(0, 50) q(j))
 SELECT c_mktsegment, count(*) AS sampled, CAST(sum(CASE WHEN c_custkey >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM r JOIN k USING (i) GROUP BY 1""")
def l13(t):
    """Counts on evenly spaced ids of each pack."""
    probe = draws.quantile_probe(t.customer, "c_custkey", "c_custkey", 50)
    return probe.groupBy("c_mktsegment").agg(count("sampled"), isum(F.col("c_custkey") >= 0, "valid"))


@query("L14_lineage_fingerprint", """SELECT sample_id, sha256('["' || sample_id || '", "' || split || '", "' || CAST(frequency_bin AS VARCHAR) || '"]') AS fingerprint FROM @manifest m WHERE split = 'train'""")
def l14(t):
    """Identity hash of every train row."""
    m = t.manifest.filter("split = 'train'")
    return checks.row_fingerprints(m, ["sample_id", "split", "frequency_bin"]).select("sample_id", "fingerprint")


@query("L14_table_fingerprint", """WITH r AS (SELECT sha256(sample_id) AS k, sha256('["' || sample_id || '", "' || split || '", "' || CAST(frequency_bin AS VARCHAR) || '"]') AS fp FROM @manifest m WHERE split = 'train'),
 a AS (SELECT substr(k, 1, 8) AS s, sha256(string_agg(fp, '' ORDER BY k, fp)) AS h, count(*) AS n FROM r GROUP BY 1),
 b AS (SELECT substr(s, 1, 5) AS s, sha256(string_agg(h, '' ORDER BY s, h)) AS h, sum(n) AS n FROM a GROUP BY 1),
 c AS (SELECT substr(s, 1, 3) AS s, sha256(string_agg(h, '' ORDER BY s, h)) AS h, sum(n) AS n FROM b GROUP BY 1)
 SELECT sha256(string_agg(h, '' ORDER BY s, h)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM c""")
def l14b(t):
    """One hash of the whole train table, equal under any partitioning."""
    return checks.table_fingerprint(t.manifest.filter("split = 'train'"), "sample_id", ["sample_id", "split", "frequency_bin"])


@query("L15_statistics_contract", f"""WITH c AS (SELECT task, count(*) AS n, avg(target) AS m, stddev_pop(target) AS s FROM @pairs p WHERE frequency_bin < 5 GROUP BY task), o AS (SELECT task, count(*) AS n, avg(target) AS m, stddev_pop(target) AS s FROM @pairs p GROUP BY task)
 SELECT task, {R('c.m')} AS train_mean, {R('c.s')} AS train_std, c.s > 0 AND abs(c.m - o.m) <= 1e-3*abs(o.m) AS consistent FROM c JOIN o USING (task)""")
def l15(t):
    """Train statistics recombined from cohorts must be positive and match."""
    p = t.pairs
    parts = metrics.moments(p.filter("frequency_bin < 5"), ["task", "sampling_group"], "target").drop("std", "reason")
    train = metrics.merge_moments(parts, ["task"]).select("task", "mean", "std")
    whole = metrics.moments(p, ["task"], "target").select("task", F.col("mean").alias("m2"))
    ok = (F.col("std") > 0) & (F.abs(F.col("mean") - F.col("m2")) <= F.abs("m2") * 1e-3)
    return train.join(whole, "task").select("task", r6("mean").alias("train_mean"), r6("std").alias("train_std"), ok.alias("consistent"))


@query("L16_immutable_subset", "SELECT c_custkey, c_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 100 = 3 THEN c_name || '!' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 1) s EXCEPT ALL SELECT c_custkey, c_name FROM customer")
def l16(t):
    """Selected rows that differ from the source."""
    src = t.customer.select("c_custkey", "c_name")
    sel = src.filter("c_custkey % 2 = 1").withColumn("c_name", F.when(F.col("c_custkey") % 100 == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return checks.changed_rows(sel, src)


@query("L17_common_support_equality", """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'missing_variant' WHEN (c_custkey % 3 = 0) <> (c_custkey % 6 = 0) THEN 'support_differs' ELSE 'label_without_support' END AS violation FROM customer WHERE c_custkey % 11 = 0 OR (c_custkey % 3 = 0) <> (c_custkey % 6 = 0) OR (c_custkey % 5 = 0 AND c_custkey % 3 <> 0)""")
def l17(t):
    """Variants must share their support, and labels need support."""
    c = t.customer.select(F.col("c_custkey").alias("id"))
    a = c.select("id", (F.col("id") % 3 == 0).alias("support"), (F.col("id") % 5 == 0).alias("labelled"))
    b = c.filter("id % 11 <> 0").select("id", (F.col("id") % 6 == 0).alias("support"), F.lit(False).alias("labelled"))
    return checks.support_mismatch(a, b, "id", "support", "labelled")
