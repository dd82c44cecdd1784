"""Queries over scans, predicates and scalar functions (families A, B, H, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtally.functions import bins, calendar as cal, keys as K, radiometry as rad
from landtally.operators import checks, pixels
from landtally.plans.intervals import W0, W1
from landtally.plans.registry import D, R, day_text, query, r6
from landtally.session import scratch_folder
from landtally.sources import metadata, series, tables

SPLIT = lambda h: f"CASE WHEN CAST(('0x' || substr({h},1,8)) AS BIGINT) % 100 < 70 THEN 'train' WHEN CAST(('0x' || substr({h},1,8)) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"
BLOCK = "concat(CAST(CAST(floor((lon+180)/5) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor((lat+90)/5) AS BIGINT) AS VARCHAR))"


# --- A ------------------------------------------------------------------------------------------

@query("A1_scan_manifest", f"""SELECT sample_id, split, {SPLIT(f"sha256('[42, ' || chr(34) || block || chr(34) || ']')")} AS expected_split FROM @manifest m
 WHERE split <> {SPLIT(f"sha256('[42, ' || chr(34) || block || chr(34) || ']')")}""")
def a1(t):
    """Manifest rows whose stored split differs from the recomputed one."""
    return checks.split_mismatch(t.manifest, "sample_id", "split", "lon", "lat", 42)


@query("A2_scan_sensor_text", f"""SELECT user_id AS sensor, CAST(floor(epoch(date_trunc('minute', ts))) AS BIGINT) AS t_s, {R('value')} AS value, event_type <> 'error' AS good FROM events WHERE event_type <> 'view'""")
def a2(t):
    """Whitespace records parsed from text lines; headers and malformed lines drop out."""
    line = """CASE WHEN event_type = 'view' THEN 'CSE CSE Station 45.0 6.0' ELSE concat(date_format(ts, 'yyyy/MM/dd HH:mm'), '  ', CAST(value AS STRING), ' ', CASE WHEN event_type = 'error' THEN 'D01' ELSE 'G' END, ' M') END"""
    lines = t.events.selectExpr("user_id AS sensor", f"{line} AS value")
    out = series.parse_sensor_lines(lines)
    return out.select("sensor", "t_s", r6("value").alias("value"), "good")


@query("A3_scan_sensor_header", """WITH h AS (SELECT p_partkey AS file_id, p_size / 100.0 - 0.1 AS a, p_size / 500.0 AS b, p_type, p_brand FROM part)
 SELECT file_id, CASE WHEN a < 0 OR b > 0.05 THEN 'not_shallow' WHEN p_type = 'ECONOMY' THEN 'not_point' WHEN p_brand LIKE '%3' THEN 'aggregated_sensor' END AS reason FROM h""")
def a3(t):
    """Eligibility of a sensor from its quoted header."""
    line = """concat('"NET" "', p_name, '" "45.0" "6.0" "100" "', CAST(p_size / 100.0 - 0.1 AS STRING), '" "', CAST(p_size / 500.0 AS STRING), '" "', CASE WHEN p_brand LIKE '%3' THEN 'mean of three' ELSE 'probe' END, '" "', CASE WHEN p_type = 'ECONOMY' THEN 'grid' ELSE 'point' END, '"')"""
    out = series.parse_sensor_header(t.part.selectExpr("p_partkey AS file_id", f"{line} AS line"), "line")
    return out.select("file_id", "reason")


@query("A4_scan_flux_csv", f"SELECT station, start_s, end_s, {R('CASE WHEN qc = 2 THEN NULL ELSE le END')} AS le FROM @flux f")
def a4(t):
    """Local interval text to UTC seconds with missing markers cleaned."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(F.col(c) + F.col("offset_s")), "yyyyMMddHHmm")
    raw = t.flux.select("station", (F.col("offset_s") / 3600).alias("utc_offset"), stamp("start_s").alias("TIMESTAMP_START"), stamp("end_s").alias("TIMESTAMP_END"),
                        F.when(F.col("qc") == 2, "-9999").otherwise(F.col("le").cast("string")).alias("LE_F_MDS"))
    out = series.flux_intervals(raw, F.col("utc_offset"), ["LE_F_MDS"], ["station"])
    return out.select("station", "start_s", "end_s", r6("LE_F_MDS").alias("le"))


_BIF = """WITH r AS (SELECT c_nationkey AS site, 'LOCATION_LAT' AS v, CAST(c_nationkey * 3 + CASE WHEN c_nationkey % 4 = 0 THEN c_custkey % 2 ELSE 0 END AS {txt}) AS d FROM {cust}
 UNION ALL SELECT c_nationkey, 'LOCATION_LONG', CAST(c_nationkey * 9 AS {txt}) FROM {cust} UNION ALL SELECT c_nationkey, 'IGBP', c_mktsegment FROM {cust} WHERE c_nationkey % 5 = 0)"""


@query("A5_scan_metadata", _BIF.format(txt="VARCHAR", cust="customer") + f""", g AS (SELECT site, min(CASE WHEN v='LOCATION_LAT' THEN d END) AS a0, max(CASE WHEN v='LOCATION_LAT' THEN d END) AS a1, min(CASE WHEN v='LOCATION_LONG' THEN d END) AS b0, max(CASE WHEN v='LOCATION_LONG' THEN d END) AS b1,
  min(CASE WHEN v='IGBP' THEN d END) AS c0, max(CASE WHEN v='IGBP' THEN d END) AS c1 FROM r GROUP BY site)
 SELECT site, {R('CASE WHEN a0=a1 AND CAST(a0 AS DOUBLE) <= 90 THEN a0 END')} AS lat, {R('CASE WHEN b0=b1 AND CAST(b0 AS DOUBLE) <= 180 THEN b0 END')} AS lon, CASE WHEN c0=c1 THEN c0 END AS igbp,
  concat_ws(';', CASE WHEN a0 <> a1 THEN 'ambiguous LOCATION_LAT' WHEN CAST(a0 AS DOUBLE) > 90 THEN 'invalid LOCATION_LAT' END, CASE WHEN CAST(b0 AS DOUBLE) > 180 THEN 'invalid LOCATION_LONG' END, 'missing UTC_OFFSET', CASE WHEN c0 IS NULL THEN 'missing IGBP' WHEN c0 <> c1 THEN 'ambiguous IGBP' END) AS issue FROM g""")
def a5(t):
    """Site attributes accepted only with exactly one valid value."""
    c = t.customer
    lat = (F.col("c_nationkey") * 3 + F.when(F.col("c_nationkey") % 4 == 0, F.col("c_custkey") % 2).otherwise(0)).cast("string")
    rows = c.select(F.col("c_nationkey").alias("site"), F.inline(F.array_compact(F.array(
        F.struct(F.lit("LOCATION_LAT").alias("VARIABLE"), lat.alias("DATAVALUE")), F.struct(F.lit("LOCATION_LONG").alias("VARIABLE"), (F.col("c_nationkey") * 9).cast("string").alias("DATAVALUE")),
        F.when(F.col("c_nationkey") % 5 == 0, F.struct(F.lit("IGBP").alias("VARIABLE"), F.col("c_mktsegment").alias("DATAVALUE")))))))
    out = metadata.site_attributes(rows, ["site"])
    return out.select("site", r6("LOCATION_LAT").alias("lat"), r6("LOCATION_LONG").alias("lon"), F.col("IGBP").alias("igbp"), "issue")


@query("A6_source_index", """SELECT user_id AS file_id, count(*) AS records, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s,
  concat_ws(',', CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) > 10 THEN 'view' END) AS footprint_columns FROM events GROUP BY user_id""")
def a6(t):
    """Records, first and last time per file, and its columns that match a pattern."""
    e = t.events.select(F.col("user_id").alias("file_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t_s"), "event_type")
    index = series.source_index(e, "file_id", "t_s")
    names = e.groupBy("file_id", "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 10").groupBy("file_id").agg(F.array_sort(F.collect_list("event_type")).alias("columns"))
    out = index.join(names, "file_id", "left")
    return out.select("file_id", "records", "first_s", "last_s", F.coalesce(F.array_join(series.columns_like(F.col("columns"), "^vi"), ","), F.lit("")).alias("footprint_columns"))


@query("A7_scan_points", f"""SELECT doc_id, {R('CASE WHEN doc_id % 10 <> 3 THEN lon END')} AS lon, cls, CASE WHEN doc_id % 10 = 3 THEN 'geometry' WHEN abs(lon) > 180 THEN 'domain' WHEN yr NOT BETWEEN 2017 AND 2024 THEN 'year' WHEN cls IS NULL THEN 'class' END AS reason FROM
 (SELECT doc_id, (doc_id * 7 % 400) - 200.0 AS lon, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS cls, 2015 + doc_id % 12 AS yr FROM documents) d""")
def a7(t):
    """Points from WKT with class numbers and reasons."""
    d = t.sql("""SELECT doc_id, CASE lang WHEN 'en' THEN 'water' WHEN 'fr' THEN 'snow_ice' WHEN 'de' THEN 'land' ELSE lang END AS label, 2015 + doc_id % 12 AS yr,
      CASE WHEN doc_id % 10 = 3 THEN 'LINESTRING (0 0, 1 1)' WHEN doc_id % 10 = 4 THEN concat('MULTIPOINT ((', CAST((doc_id * 7 % 400) - 200.0 AS STRING), ' 5.5))') ELSE concat('POINT (', CAST((doc_id * 7 % 400) - 200.0 AS STRING), ' 5.5)') END AS geometry FROM $documents""")
    p = series.parse_points(d)
    return p.select("doc_id", r6("lon").alias("lon"), "cls", series.point_reason(F.col("yr")).alias("reason"))


@query("A8_scan_station_archive", f"SELECT location_id, {R('lon')} AS lon, landcover_name FROM @stations s WHERE c_custkey % 10 / 100.0 <= 0.05 AND lon BETWEEN -60 AND 90 AND lat BETWEEN -30 AND 40")
def a8(t):
    """Series filtered by depth and area."""
    s = t.stations.withColumn("depth_to", F.col("c_custkey") % 10 / 100.0)
    return series.archive_series(s, 0.05, (-60, -30, 90, 40)).select("location_id", r6("lon").alias("lon"), "landcover_name")


@query("A9_scan_flux_et", f"""WITH s AS (SELECT sensor, t_s, value, t_s - lag(t_s) OVER (PARTITION BY sensor ORDER BY t_s) AS step FROM @sensor x), m AS (SELECT sensor, quantile_cont(CAST(step AS DOUBLE), 0.5) AS med FROM s GROUP BY sensor)
 SELECT sensor, {R('sum(value * med / 2.45e6)', 8)} AS et_mm FROM s JOIN m USING (sensor) GROUP BY sensor""")
def a9(t):
    """Water depth per interval from the first available flux column and the median step."""
    s = t.sensor.select("sensor", "t_s", F.col("value").alias("LE_F_MDS"))
    le = series.find_column(s.columns, series.LE_COLUMNS)
    return series.evaporation(s, ["sensor"], "t_s", le).groupBy("sensor").agg(r6(F.sum("et_mm"), 8).alias("et_mm"))


@query("A10_scene_catalog", """WITH n AS (SELECT page_id % 200 AS scene_id, 'S2A_MSIL1C_' || CAST(20200101 + page_id % 28 AS VARCHAR) || 'T000000_T' || CAST(10 + page_id % 50 AS VARCHAR) || 'ABC_X' AS name FROM pages)
 SELECT scene_id, min(name) AS name, strftime(strptime(regexp_extract(min(name), '(20[0-9]{6})', 1), '%Y%m%d'), '%Y-%m-%d') AS date, regexp_extract(min(name), '_T([0-9]{2}[A-Z]{3})_', 1) AS tile FROM n GROUP BY scene_id""")
def a10(t):
    """Scenes dated and tiled from their names, one row per id."""
    p = t.sql("SELECT page_id % 200 AS scene_id, concat('S2A_MSIL1C_', CAST(20200101 + page_id % 28 AS STRING), 'T000000_T', CAST(10 + page_id % 50 AS STRING), 'ABC_X') AS name FROM $pages")
    out = tables.scene_catalog(p)
    return out.select("scene_id", "name", day_text("date").alias("date"), "tile")


@query("A11_scan_label_records", """WITH r AS (SELECT CAST(l_orderkey * 2 AS VARCHAR) AS sample_id FROM lineitem WHERE l_linenumber = 1)
 SELECT sample_id, 'duplicate' AS violation FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, 'unknown' FROM r WHERE sample_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)""")
def a11(t):
    """Label records with repeated or unknown ids."""
    r = t.lineitem.filter("l_linenumber = 1").select((F.col("l_orderkey") * 2).cast("string").alias("sample_id"), F.col("l_quantity").alias("value"))
    return tables.label_records(t.manifest, r)[1]


@query("A12_sink_manifest", "SELECT split, count(*) AS n, CAST(sum(frequency_bin) AS BIGINT) AS bins FROM @manifest m GROUP BY split")
def a12(t):
    """A manifest written by split, read back and counted."""
    folder = scratch_folder(t.spark, "manifest")
    tables.write_manifest(t.manifest, f"{folder}/manifest.parquet")
    out = t.spark.read.parquet(f"{folder}/manifest.parquet")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("frequency_bin").alias("bins"))


@query("A13_sink_reports", "SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) x GROUP BY status")
def a13(t):
    """Two appends to a ledger, read back with a strict schema."""
    folder = scratch_folder(t.spark, "ledger")
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    tables.append_ledger(o, folder)
    tables.append_ledger(o.filter("o_orderkey % 2 = 0"), folder)
    back = t.spark.read.schema("o_orderkey bigint, status string").option("mode", "FAILFAST").json(folder)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- B ------------------------------------------------------------------------------------------

_V = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 20.0 * (event_id % 7) WHEN event_id % 23 = 0 THEN -1.0 ELSE value END"
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@query("B1_frequency_bin", f"WITH v AS (SELECT event_id, {_V} AS v FROM events) SELECT event_id, CASE WHEN v < 0 OR v > 100 OR v IS NULL THEN NULL WHEN v = 0 THEN 0 WHEN v = 100 THEN 6 ELSE CAST(floor(v/20) AS INTEGER) + 1 END AS bin FROM v")
def b1(t):
    """Bins with the lower edge included."""
    return t.sql(f"SELECT event_id, {_V} AS v FROM $events").select("event_id", bins.frequency_bin(F.col("v")).alias("bin"))


@query("B2_frequency_bin_legacy", f"WITH v AS (SELECT event_id, {_V} AS v FROM events) SELECT event_id, CASE WHEN v < 0 OR v > 100 OR v IS NULL THEN NULL WHEN v = 0 THEN 0 WHEN v = 100 THEN 6 ELSE least(5, CAST(ceil(v/20) AS INTEGER)) END AS bin FROM v")
def b2(t):
    """The older bins with the upper edge included."""
    return t.sql(f"SELECT event_id, {_V} AS v FROM $events").select("event_id", bins.frequency_bin_upper(F.col("v")).alias("bin"))


@query("B3_observed_occurrence", f"""WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_K} END AS occ, event_id % 4 AS obs FROM events)
 SELECT event_id, {R('CASE WHEN occ IS NOT NULL THEN occ WHEN obs > 0 THEN 0 END')} AS occurrence, CASE WHEN occ IS NULL AND obs <= 0 THEN 'unobserved' END AS reason FROM v""")
def b3(t):
    """A never-water zero needs evidence of valid observations."""
    from landtally.functions.labels import observed_occurrence

    v = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.from_json("props", "k double")["k"]).alias("occ"), (F.col("event_id") % 4).alias("obs"))
    value, reason = observed_occurrence(F.col("occ"), F.col("obs"))
    return v.select("event_id", r6(value).alias("occurrence"), reason.alias("reason"))


@query("B4_inside_split_block", """WITH p AS (SELECT sample_id, ((lon+180) % 5) AS a, ((lat+90) % 5) AS b, lat FROM @manifest m)
 SELECT sample_id, least(least(a, 5-a)*111320*cos(radians(lat)), least(b, 5-b)*111320) >= 35000 AS inside FROM p""")
def b4(t):
    """Far enough from the edges of the block."""
    return t.manifest.select("sample_id", K.inside_split_block(F.col("lon"), F.col("lat")).alias("inside"))


@query("B5_station_area_filter", "SELECT location_id FROM @stations s WHERE lon BETWEEN -60 AND 90 AND lat BETWEEN -30 AND 40 AND (c_custkey % 30 < 25 AND c_custkey % 30 + 5 > 8)")
def b5(t):
    """Stations inside an area whose period meets the study period; columns found by alias."""
    from landtally.functions.labels import in_polygon

    s = t.stations.withColumnRenamed("lon", "Longitude").withColumnRenamed("lat", "LATITUDE")
    lon, lat = series.find_column(s.columns, ("lon", "longitude", "x")), series.find_column(s.columns, ("lat", "latitude", "y"))
    ring = [(-60, -30), (90, -30), (90, 40), (-60, 40)]
    period = (F.col("c_custkey") % 30 < 25) & (F.col("c_custkey") % 30 + 5 > 8)
    return s.filter(in_polygon(F.col(lon), F.col(lat), ring) & period).select("location_id")


_SUP = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 1 - l_tax END AS known, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount / 3 END AS water_ice, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE 1 - l_tax / 2 END AS known2, l_discount / 4 AS water_ice2, l_linenumber % 3 AS valid_days, l_quantity AS value FROM {t}"
_OK = lambda k, w: f"(coalesce({k},0) > 0.95 AND coalesce({w},1) + (1 - coalesce({k},0)) < 0.05)"


@query("B6_sm_support_eligible", f"SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN {_OK('known','water_ice')} THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM ({_SUP.format(t='lineitem')}) s GROUP BY l_linenumber")
def b6(t):
    """Known enough and little contaminated; unknown counts against."""
    from landtally.functions.labels import sm_support_eligible

    s = t.sql(_SUP.format(t="$lineitem"))
    ok = sm_support_eligible(F.col("known"), F.col("water_ice"))
    return s.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("eligible"))


@query("B7_sm_eligible", f"SELECT l_linenumber, CAST(sum(CASE WHEN {_OK('known','water_ice')} AND {_OK('known2','water_ice2')} AND valid_days > 0 AND value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM ({_SUP.format(t='lineitem')}) s GROUP BY l_linenumber")
def b7(t):
    """Both supports pass, with valid days and a finite value."""
    from landtally.functions.labels import sm_eligible

    s = t.sql(_SUP.format(t="$lineitem")).select("*", F.struct(F.col("known"), F.col("water_ice")).alias("grid"), F.struct(F.col("known2").alias("known"), F.col("water_ice2").alias("water_ice")).alias("footprint"))
    ok = sm_eligible(F.col("grid"), F.col("footprint"), F.col("valid_days"), F.col("value"))
    return s.groupBy("l_linenumber").agg(F.sum(ok.cast("int")).alias("eligible"))


@query("B8_sm_tile_eligible", f"SELECT tile, {R('sum(coalesce(CASE WHEN valid THEN abs(value)*3 END,0))/64', 9)} AS tile_land, sum(coalesce(CASE WHEN valid THEN abs(value)*3 END,0))/64 > 0.3 AS eligible FROM @pixels p GROUP BY tile")
def b8(t):
    """Land share over all pixels of the tile, missing ones included."""
    from landtally.functions.labels import sm_tile_land

    p = t.pixels
    out = p.groupBy("tile").agg(sm_tile_land(F.when(F.col("valid"), F.abs("value") * 3), 64).alias("tile_land"))
    return out.select("tile", r6("tile_land", 9).alias("tile_land"), (F.col("tile_land") > 0.3).alias("eligible"))


@query("B9_ice_centre_eligible", "SELECT tile FROM @pixels p WHERE row = 4 AND col = 4 AND valid AND value >= 0.1")
def b9(t):
    """The centre cell is valid and icy."""
    from landtally.functions.labels import is_centre

    return t.pixels.filter(is_centre(8, 8) & F.col("valid") & (F.col("value") >= 0.1)).select("tile")


@query("B10_accept_observations", "SELECT sensor, count(DISTINCT t_s // 86400 % 5) >= 4 AND max(t_s) >= 1706572800 - 3*86400 AS accepted FROM @sensor s WHERE good GROUP BY sensor")
def b10(t):
    """Enough distinct slots and a recent latest observation."""
    from landtally.functions.labels import accept_observations

    s = t.sensor.filter("good").withColumn("slot", F.floor(F.col("t_s") / 86400) % 5)
    return accept_observations(s, ["sensor"], "slot", "t_s", F.lit(1706572800), 4, 3)


@query("B11_update_recency", f"""WITH a AS (SELECT sensor, max(t_s) AS last, {D('CAST(make_timestamp(max(t_s)*1000000) AS DATE)')} AS day FROM @sensor s WHERE good GROUP BY sensor)
 SELECT day, count(*) FILTER (WHERE 1706659200 - last <= 1*86400) AS accepted_before, count(*) FILTER (WHERE 1706659200 - last <= 3*86400) AS accepted_after FROM a GROUP BY day""")
def b11(t):
    """Acceptance per date before and after relaxing the age limit."""
    from landtally.functions.labels import relaxed_counts

    a = t.sensor.filter("good").groupBy("sensor").agg(F.max("t_s").alias("last")).withColumn("day", day_text(F.timestamp_seconds("last").cast("date")))
    return relaxed_counts(a, ["day"], (F.lit(1706659200) - F.col("last")) / 86400, 1, 3)


@query("B12_flux_eligibility", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lon IS NULL THEN 'unresolved_metadata' WHEN c_acctbal < 500 THEN 'missing_et_fields' WHEN c_custkey % 30 < 6 THEN 'no_period_overlap' ELSE 'eligible' END AS reason FROM @stations s) x GROUP BY reason""")
def b12(t):
    """First matching exclusion reason per file."""
    from landtally.functions.labels import first_reason

    s = t.stations
    reason = first_reason({"unresolved_metadata": F.col("lon").isNull(), "missing_et_fields": F.col("c_acctbal") < 500, "no_period_overlap": F.col("c_custkey") % 30 < 6})
    return s.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("B13_static_quality", """WITH p AS (SELECT place, CAST(abs(value)*40 AS INTEGER) % 3 AS label, abs(value)*5 AS prob, valid, image, row, col FROM @pixels p WHERE image < 7),
 c AS (SELECT place, count(*) FILTER (WHERE valid AND prob >= 0.3 AND label = 0) AS c0, count(*) FILTER (WHERE valid AND prob >= 0.3 AND label = 1) AS c1, count(*) FILTER (WHERE valid AND prob >= 0.3 AND label = 2) AS c2, count(*) FILTER (WHERE valid) AS seen FROM p GROUP BY place),
 d AS (SELECT *, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS dominant, greatest(c0,c1,c2)/448.0 AS hf, seen/448.0 AS vf FROM c)
 SELECT place, CAST(dominant AS INTEGER) AS dominant, """ + R("hf") + " AS homogeneous_fraction, " + R("vf") + """ AS valid_fraction, concat_ws(',', CASE WHEN vf < 0.85 THEN 'insufficient_contemporary_classification_coverage' END, CASE WHEN hf < 0.2 THEN 'insufficient_homogeneous_whole_area' END,
  CASE WHEN place % 3 = 2 THEN 'unresolved_source_landcover' WHEN dominant <> 1 THEN 'source_landcover_disagreement' END) AS reasons FROM d""")
def b13(t):
    """Dominant class over a fixed number of cells, missing cells included."""
    p = t.pixels.filter("image < 7").select("place", (F.round(F.abs("value") * 40).cast("int") % 3).alias("label"), (F.abs("value") * 5).alias("probability"), F.col("valid").alias("observed"),
                        F.when(F.col("place") % 3 == 2, F.lit("?")).otherwise("ENF;DBF").alias("igbp"))
    p = p.withColumn("expected", rad.igbp_classes(F.col("igbp")))
    out = pixels.static_quality(p, ["place"], "expected", 0.3, 0.85, 0.2, cells=448)
    return out.select("place", "dominant", r6("homogeneous_fraction").alias("homogeneous_fraction"), r6("valid_fraction").alias("valid_fraction"), F.array_join("reasons", ",").alias("reasons"))


_FFP = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 2.0 AS zm, l_quantity / 4.0 * (l_linenumber % 3) AS canopy, l_linenumber * 1.0 AS ws, l_extendedprice / 50.0 AS h, (l_suppkey % 21 - 10) * 3.0 AS ol, 0.1 + l_discount * 5 AS sigmav, l_tax * 5 AS ustar, CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE (l_partkey * 7 % 380) * 1.0 END AS wd FROM {t}"""


@query("B14_parameter_valid", f"""SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN wd IS NOT NULL AND zm > 0 AND canopy >= 0 AND zm > 1.875*canopy AND ws > 0 AND h > 10 AND zm < h AND ol <> 0 AND zm/nullif(ol,0) > -15.5 AND sigmav > 0 AND ustar > 0.1 AND wd BETWEEN 0 AND 360 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM ({_FFP.format(t='lineitem')}) f GROUP BY l_linenumber""")
def b14(t):
    """Physical domain of the footprint parameters."""
    from landtally.operators import footprint

    f = t.sql(_FFP.format(t="$lineitem"))
    ok = footprint.parameter_valid({k: F.col(k) for k in (*footprint.PARAMETERS, "canopy")})
    return f.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("valid"))


@query("B15_lst_eligible", "SELECT tile, CAST(sum(CASE WHEN valid AND value IS NOT NULL AND abs(value)*15 <= 2 AND col < 7 THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM @pixels p GROUP BY tile")
def b15(t):
    """Valid, observed and certain enough surface temperature."""
    from landtally.functions.labels import lst_eligible

    ok = lst_eligible(F.col("valid"), F.col("value"), F.abs("value") * 15, F.col("col") < 7)
    return t.pixels.groupBy("tile").agg(F.sum(ok.cast("int")).alias("eligible"))


@query("B16_display_values", f"SELECT tile, count(shown) AS shown, {R('sum(shown)')} AS total FROM (SELECT tile, CASE WHEN valid AND abs(value) >= 0.1 THEN value END AS shown FROM @pixels p) x GROUP BY tile")
def b16(t):
    """Values shown only where the surface fraction is large enough."""
    from landtally.functions.labels import display_value

    shown = display_value(F.col("value"), F.col("valid"), F.abs("value"), 0.1)
    return t.pixels.select("tile", shown.alias("s")).groupBy("tile").agg(F.count("s").alias("shown"), r6(F.sum("s")).alias("total"))


@query("B17_valid_cover_domain", "SELECT doc_id FROM documents WHERE doc_id * 7 % 400 - 200 BETWEEN -180 AND 180 AND doc_id % 200 - 100 >= -60 AND doc_id % 200 - 100 < 84 AND 2015 + doc_id % 12 BETWEEN 2017 AND 2024 AND lang IN ('en','fr','de')")
def b17(t):
    """Points in the domain, the years and the known classes."""
    d = t.documents.select("doc_id", (F.col("doc_id") * 7 % 400 - 200).cast("double").alias("lon"), (F.col("doc_id") % 200 - 100).cast("double").alias("lat"), F.when(F.col("lang").isin("en", "fr", "de"), 1).alias("cls"))
    return d.filter(series.point_reason(2015 + F.col("doc_id") % 12).isNull()).select("doc_id")


@query("B18_causal_inputs", """WITH i AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t_s FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_s DESC, event_id DESC) AS rn FROM i) SELECT user_id, event_type, event_id AS latest, t_s FROM r WHERE rn = 1""")
def b18(t):
    """Only observations before the end of the target day; the latest per modality."""
    from landtally.functions.labels import causal_latest

    e = t.events.select("user_id", "event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t_s"))
    return causal_latest(e, ["user_id", "event_type"], "t_s", F.lit("2024-01-19").cast("date"), "event_id").select("user_id", "event_type", F.col("event_id").alias("latest"), "t_s")


@query("B19_explode_observations", """WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_returnflag FROM lineitem)
 SELECT concat('0:', sample_id, ':et:', CAST(idx AS VARCHAR)) AS key, """ + R("l_quantity") + " AS value FROM o WHERE l_returnflag <> 'R'")
def b19(t):
    """One row per valid observation with a stable key; the index counts invalid ones too."""
    from landtally.functions.labels import explode_observations

    l = t.lineitem.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("value"), (F.col("l_returnflag") != "R").alias("valid")).alias("o"))
    s = l.groupBy("sample_id").agg(F.array_sort(F.collect_list("o")).alias("observations"))
    out = explode_observations(s, "sample_id", "observations", F.lit("0"), F.lit("et"))
    return out.select("key", r6("value").alias("value"))


# --- H ------------------------------------------------------------------------------------------

@query("H1_fingerprint", """SELECT sample_id, sha256('[43, ' || chr(34) || sample_id || chr(34) || ', ' || chr(34) || strftime(target_time, '%Y-%m-%d') || chr(34) || ']') AS fp FROM @manifest m""")
def h1(t):
    """Hash of a spaced JSON list."""
    return t.manifest.select("sample_id", K.fingerprint(43, K.quoted(F.col("sample_id")), K.quoted(day_text("target_time"))).alias("fp"))


@query("H2_hash_percent", """WITH h AS (SELECT sample_id, sha256('[43, ' || chr(34) || sample_id || chr(34) || ']') AS h FROM @manifest m) SELECT sample_id, CAST(('0x' || substr(h,1,8)) AS BIGINT) % 100 AS percent, """ + SPLIT("h") + " AS split FROM h")
def h2(t):
    """Percent and split of a seeded hash."""
    h = K.fingerprint(43, K.quoted(F.col("sample_id")))
    return t.manifest.select("sample_id", K.hash_percent(h).alias("percent"), K.split_of_percent(K.hash_percent(h)).alias("split"))


@query("H3_geographic_block", f"SELECT sample_id, {BLOCK} AS block, concat(CAST(CAST(floor(lon/5) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lat/5) AS BIGINT) AS VARCHAR)) AS signed_block FROM @manifest m")
def h3(t):
    """Both block labels."""
    return t.manifest.select("sample_id", K.geographic_block(F.col("lon"), F.col("lat")).alias("block"), K.signed_block(F.col("lon"), F.col("lat")).alias("signed_block"))


@query("H4_epoch", "SELECT event_id, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS plain, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS zulu, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) - 7200 AS shifted FROM events")
def h4(t):
    """ISO text with and without a zone."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = t.events.select("event_id", text.alias("s"))
    return e.select("event_id", cal.parse_epoch(F.col("s")).alias("plain"), cal.parse_epoch(F.concat("s", F.lit("Z"))).alias("zulu"), cal.parse_epoch(F.concat("s", F.lit("+02:00"))).alias("shifted"))


@query("H5_local_to_utc", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST((event_id % 25 - 12) * 1800 AS BIGINT) AS utc_s FROM events")
def h5(t):
    """Local seconds to UTC with half-hour offsets."""
    return t.events.select("event_id", cal.to_utc(F.unix_seconds(F.col("ts").cast("timestamp")), (F.col("event_id") % 25 - 12) / 2).alias("utc_s"))


@query("H6_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(year(o_orderdate) AS VARCHAR) || ':' || CAST((month(o_orderdate)-1)//3 AS VARCHAR) AS season FROM orders")
def h6(t):
    """Calendar parts and the season label."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofyear(d).alias("doy"), cal.season(d).alias("season"))


@query("H7_regex_extract", """SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS digits, regexp_matches(url, '(page|ref)=') AS flagged FROM pages""")
def h7(t):
    """Host, digits and a pattern flag of a URL."""
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/([0-9]+)", 1), F.lit("")).alias("digits"), F.col("url").rlike("(page|ref)=").alias("flagged"))


@query("H8_alias_resolve", f"SELECT {R('avg(c_acctbal)')} AS mean_value, 'c_acctbal' AS resolved FROM customer")
def h8(t):
    """First matching column name, ignoring case."""
    name = series.find_column(t.customer.columns, ("balance", "C_ACCTBAL", "c_name"))
    return t.customer.agg(r6(F.avg(name)).alias("mean_value")).withColumn("resolved", F.lit(name))


@query("H9_json_columns", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"half":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 2 AS VARCHAR) || '}' AS encoded FROM events""")
def h9(t):
    """JSON text decoded to a struct and encoded again."""
    e = tables.decode_json(t.events.select("event_id", "props"), "props", "k bigint")
    out = e.select("event_id", F.col("props.k").alias("k"), F.struct(F.col("props.k").alias("k"), F.floor(F.col("props.k") / 2).alias("half")).alias("encoded"))
    return tables.encode_json(out, "encoded")


@query("H10_db_power", f"SELECT l_partkey, {R('10*log10(avg(pow(10, (l_quantity-30)/10)))')} AS mean_db FROM lineitem GROUP BY l_partkey")
def h10(t):
    """Decibels averaged as power."""
    return t.lineitem.groupBy("l_partkey").agg(r6(rad.db_of_power(F.avg(rad.power_of_db(F.col("l_quantity") - 30)))).alias("mean_db"))


@query("H11_normalize", f"""SELECT vec_id, pos, {R("CASE WHEN abs(p) > 0.001 THEN (p - b.m)/(4*b.s)+0.5 ELSE 0 END")} AS pretrained, {R("CASE WHEN abs(p) > 0.001 THEN (p - 0.1)/2.5+0.5 ELSE 0 END")} AS toa FROM @probabilities q JOIN (SELECT CAST(i AS INTEGER) AS band, 0.01*i AS m, 0.1+0.02*i AS s FROM range(0,9) r(i)) b ON pos = band""")
def h11(t):
    """Band-wise normalisation; invalid values become zero."""
    spec = t.spark.range(9).select(F.col("id").cast("int").alias("pos"), (F.col("id") * 0.01).alias("m"), (F.col("id") * 0.02 + 0.1).alias("s"))
    q = t.probabilities.join(F.broadcast(spec), "pos")
    ok = F.abs("p") > 0.001
    return q.select("vec_id", "pos", r6(rad.normalize_pretrained(F.col("p"), F.col("m"), F.col("s"), ok)).alias("pretrained"), r6(rad.normalize_toa(F.col("p"), F.lit(0.1), F.lit(2.5), ok)).alias("toa"))


@query("H12_qa_bits", "SELECT p_partkey, (p_partkey & 31) = 0 AND p_size % 7 = 0 AS landsat_clear, p_size % 12 NOT IN (0,1,3,8,9,10) AS scl_clear, CAST((p_partkey >> 2) & 3 AS BIGINT) AS lst_bits FROM part")
def h12(t):
    """Quality bits."""
    return t.part.select("p_partkey", rad.landsat_clear(F.col("p_partkey"), F.col("p_size") % 7).alias("landsat_clear"), rad.scene_class_clear(F.col("p_size") % 12).alias("scl_clear"), rad.bits(F.col("p_partkey"), 2, 2).alias("lst_bits"))


@query("H13_scale_offset", f"SELECT p_partkey, {R('2.75e-5*p_partkey*10-0.2')} AS sr, {R('0.00341802*p_partkey*10+149')} AS lst, {R('p_size*0.1')} AS lai, {R('p_size*0.01')} AS et, {R('greatest(0, (p_partkey-1000)*1e4/10000.0)')} AS toa FROM part")
def h13(t):
    """Digital numbers to units."""
    dn, size = F.col("p_partkey") * 10, F.col("p_size")
    return t.part.select("p_partkey", r6(rad.apply_scale(dn, "surface_reflectance")).alias("sr"), r6(rad.apply_scale(dn, "surface_temperature")).alias("lst"), r6(rad.apply_scale(size, "lai")).alias("lai"), r6(rad.apply_scale(size, "et")).alias("et"),
                         r6(rad.scale_toa(F.col("p_partkey"), F.lit(-1000), F.lit(10000.0))).alias("toa"))


_ARG = """w AS (SELECT vec_id, min(image) AS image, min(label) AS label, arg_max(pos, p) AS win, max(CASE WHEN pos=0 THEN p END) AS pw, max(CASE WHEN pos=8 THEN p END) AS pi, sum(CASE WHEN pos BETWEEN 1 AND 7 THEN p ELSE 0 END) AS pl FROM @probabilities q GROUP BY vec_id),
 s AS (SELECT *, win = 0 AND pw >= 0.35 AS water, pi >= 0.6 AS snow_ice, pl >= 0.85 AND pw < 0.1 AND pi < 0.1 AS land FROM w)"""


@query("H14_argmax_class", f"WITH {_ARG} SELECT vec_id, CAST(win AS INTEGER) AS winner, water, snow_ice, land, water OR snow_ice OR land AS known FROM s")
def h14(t):
    """Winning class and the water, ice and land rules."""
    p = t.probabilities.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("p"))
    state = rad.cover_state(F.col("p"))
    return p.select("vec_id", rad.argmax_class(F.col("p")).alias("winner"), *[c.alias(n) for n, c in state.items()])


@query("H15_representativeness", f"SELECT l_partkey, {R('avg(coalesce(1/(1+pow(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_quantity*3 END/100, 2)),1))')} AS w FROM lineitem GROUP BY l_partkey")
def h15(t):
    """Terrain downweighting; unknown terrain counts fully."""
    sd = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity") * 3)
    return t.lineitem.groupBy("l_partkey").agg(r6(F.avg(rad.representativeness(sd))).alias("w"))


@query("H16_product_end", f"SELECT o_orderkey, {D(W0('CAST(o_orderdate AS DATE)'))} AS target_time, {D(W1(W0('CAST(o_orderdate AS DATE)')))} AS target_end FROM orders")
def h16(t):
    """Window of a date and its end, short at the year's end."""
    a = cal.window_start(F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", a.alias("a")).select("o_orderkey", day_text("a").alias("target_time"), day_text(cal.window_end(F.col("a"))).alias("target_end"))


@query("H17_scene_time_bounds", f"""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS b, o_orderdate AS i, CASE WHEN o_orderkey % 3 = 1 THEN 30 END AS n FROM orders)
 SELECT k, {D('coalesce(a, i)')} AS left_day, {D("CASE WHEN b IS NOT NULL THEN b WHEN n IS NULL THEN i ELSE CAST(least(CAST(CAST(i AS DATE) + CAST(n AS INTEGER) AS DATE), make_date(year(i)+1,1,1)) AS TIMESTAMP) END")} AS right_day FROM s""")
def h17(t):
    """Explicit interval, instant, or a span capped at the year's end."""
    i = F.col("o_orderdate").cast("timestamp")
    m = F.col("o_orderkey") % 3
    s = t.orders.select(F.col("o_orderkey").alias("k"), F.when(m == 0, i).alias("a"), F.when(m == 0, i + F.expr("INTERVAL 5 DAYS")).alias("b"), i.alias("i"), F.when(m == 1, F.lit(30)).alias("n"))
    a, b = cal.scene_time_bounds(F.col("a"), F.col("b"), F.col("i"), F.col("n"))
    return s.select("k", day_text(a).alias("left_day"), day_text(b).alias("right_day"))


@query("H18_asset_rewrite", "SELECT p_partkey, 'LANDSAT/C02/T1_L2/' || p_brand || '_' || CAST(p_size AS VARCHAR) AS asset FROM part")
def h18(t):
    """Level-1 asset names rewritten to level 2."""
    from landtally.functions.labels import level2_asset

    a = F.concat(F.lit("LANDSAT/C02/T1_L1/"), "p_brand", F.lit("_"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", level2_asset(a).alias("asset"))


@query("H19_closeness", "SELECT task, count(*) AS n, CAST(sum(CASE WHEN abs(model_b - target) <= 1e-7 + 0.05*abs(target) THEN 1 ELSE 0 END) AS BIGINT) AS close FROM @pairs p GROUP BY task")
def h19(t):
    """Agreement within relative and absolute tolerance."""
    ok = bins.close_to(F.col("model_b"), F.col("target"), 0.05, 1e-7)
    return t.pairs.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("close"))


@query("H20_igbp_classes", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1,2,5' WHEN 1 THEN '1' WHEN 2 THEN '0,4' ELSE '' END AS classes FROM customer""")
def h20(t):
    """Class numbers of a code list."""
    code = F.element_at(F.array(F.lit("WSA;SAV"), F.lit("ENF"), F.lit("CRO;WAT;XXX"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", F.array_join(F.transform(rad.igbp_classes(code), lambda c: c.cast("string")), ",").alias("classes"))


@query("H21_month_calendar", f"""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS yr FROM orders), w AS (SELECT CAST(make_date(yr,1,1) + CAST(8*i AS INTEGER) AS DATE) AS w FROM y, range(0,46) r(i)) SELECT CAST(year(w) AS INTEGER) AS year, CAST(month(w) AS INTEGER) AS month, count(*) AS windows, {D('min(w)')} AS first_window FROM w GROUP BY 1, 2""")
def h21(t):
    """Window starts by year and month."""
    y = t.orders.select(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("a")).distinct()
    w = cal.windows_between(y.withColumn("b", cal.first_of_year(F.col("a"), 1)), F.col("a"), F.col("b"))
    return w.groupBy(F.year("target_time").alias("year"), F.month("target_time").alias("month")).agg(F.count(F.lit(1)).alias("windows"), day_text(F.min("target_time")).alias("first_window"))
