"""Queries over interval series and calendars (families C4-C8, D1-D7, E5, E6, E8, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtally.functions import calendar as cal
from landtally.operators import intervals as iv, ordered
from landtally.plans.registry import D, R, day_text, query, r6, sql_span

# Window starts and ends of a date in the comparison engine.
def W0(d: str) -> str:
    return f"CAST(make_date(year({d}),1,1) + CAST(8*((dayofyear({d})-1)//8) AS INTEGER) AS DATE)"


def W1(start: str) -> str:
    return f"least(CAST({start} + 8 AS DATE), make_date(year({start})+1,1,1))"


def E(d: str) -> str:
    return f"CAST(epoch(CAST({d} AS TIMESTAMP)) AS BIGINT)"


def TOUCH(source: str) -> str:
    """Intervals with each window they touch, clipped."""
    d = lambda x: f"CAST(make_timestamp(CAST({x} AS BIGINT) * 1000000) AS DATE)"
    return f"""(SELECT *, greatest(start_s, {E('target_time')}) AS left_s, least(end_s, {E('target_end')}) AS right_s FROM
  (SELECT *, {W1('target_time')} AS target_end FROM
    (SELECT *, unnest(list_distinct([{W0(d('start_s'))}, {W0(d('end_s - 1'))}])) AS target_time FROM {source} x) y) z)"""


_L, _R = sql_span("day", "lat", "lon")
SUN = f"""sites AS (SELECT DISTINCT station, lat, lon FROM @flux f),
 raw_sun AS (SELECT station, day, {_L} AS a, {_R} AS b FROM (SELECT station, lat, lon, CAST(unnest(generate_series(DATE '2023-12-20', DATE '2024-02-20', INTERVAL 1 DAY)) AS DATE) AS day FROM sites)),
 sun AS (SELECT station, day, greatest(a, coalesce(lag(b) OVER (PARTITION BY station ORDER BY day), a)) AS a, b FROM raw_sun)"""


def LABELS(value: str, cond: str, prefix: str) -> str:
    ok = f"({cond} AND {value} IS NOT NULL AND right_s > left_s)"
    s = "(right_s - left_s)"
    return f"""sum(CASE WHEN {ok} THEN {value}*{s} ELSE 0 END) AS {prefix}_energy, sum(CASE WHEN {ok} THEN {s} ELSE 0 END) AS {prefix}_effective,
  sum(CASE WHEN {ok} AND qc = 0 THEN {s} ELSE 0 END) AS {prefix}_measured, sum(CASE WHEN {ok} THEN day_s ELSE 0 END) AS {prefix}_day, sum(CASE WHEN {ok} THEN {s} - day_s ELSE 0 END) AS {prefix}_night"""


def WITH_DAY(rows: str) -> str:
    """Adds daylight seconds of each clipped interval by a join on the station's days."""
    return f"""(SELECT c.*, coalesce((SELECT sum(greatest(0.0, least(c.right_s, s.b) - greatest(c.left_s, s.a))) FROM sun s
   WHERE s.station = c.station AND s.day BETWEEN CAST(make_timestamp(CAST(c.left_s AS BIGINT)*1000000) AS DATE) - 1 AND CAST(make_timestamp(CAST(c.left_s AS BIGINT)*1000000) AS DATE) + 1), 0.0) AS day_s FROM {rows} c)"""


FULL_DAY = f"""least(CAST({E('target_end')} - {E('target_time')} AS DOUBLE), coalesce((SELECT sum(greatest(0.0, least({E('target_end')}, s.b) - greatest({E('target_time')}, s.a))) FROM sun s
   WHERE s.station = g.station AND s.day BETWEEN g.target_time - 2 AND g.target_end + 2), 0.0))"""


def REASONS(p: str, mv: float, mm: float, md: float) -> str:
    return f"""concat_ws(',', CASE WHEN {p}_effective < {mv}*full_s THEN 'effective_duration' END, CASE WHEN {p}_measured < {mm}*full_s THEN 'measured_duration' END,
  CASE WHEN full_day > 1 AND {p}_day/full_day < {md} THEN 'day_coverage' END, CASE WHEN full_s-full_day > 1 AND {p}_night/(full_s-full_day) < {md} THEN 'night_coverage' END,
  CASE WHEN {p}_effective = 0 OR {p}_energy < 0 THEN 'missing_or_negative_window_et' END)"""


VALUE = lambda p: f"CASE WHEN {p}_effective > 0 THEN {p}_energy/{p}_effective*86400/2450000.0 END"


# Every window of each station's record, from the first it touches to the last.
SPINE = f"""spine AS (SELECT station, lat, lon, target_time, {W1('target_time')} AS target_end FROM (SELECT station, lat, lon, min(target_time) AS lo, max(target_time) AS hi FROM rows GROUP BY ALL) x,
  (SELECT CAST(make_date(CAST(y AS INT), 1, 1) + CAST(8*k AS INTEGER) AS DATE) AS target_time FROM range(2022, 2027) r(y), range(0, 46) s(k)) c WHERE target_time BETWEEN lo AND hi)"""


def ON_SPINE(*labels: str) -> str:
    """The sums of each window of the spine, 0 where it has no row."""
    parts = ", ".join(f"coalesce({p}_{c}, 0) AS {p}_{c}" for p in labels for c in ("energy", "effective", "measured", "day", "night"))
    return f"g AS (SELECT p.station, p.target_time, p.target_end, {parts} FROM spine p LEFT JOIN sums u ON u.station = p.station AND u.target_time = p.target_time)"


@query("D1_interval_et", f"""WITH {SUN}, rows AS (SELECT * FROM {WITH_DAY(TOUCH('@flux'))}),
 sums AS (SELECT station, target_time, {LABELS('le', 'qc IN (0,1)', 'v')} FROM rows GROUP BY ALL), {SPINE}, {ON_SPINE('v')},
 h AS (SELECT *, CAST({E('target_end')} - {E('target_time')} AS DOUBLE) AS full_s, {FULL_DAY} AS full_day FROM g)
 SELECT station, {D('target_time')} AS target_time, {D('target_end')} AS target_end, {R(VALUE('v'))} AS value, {REASONS('v', 0.8, 0.5, 0.8)} AS reasons,
  {R('v_effective/full_s')} AS valid_fraction, {R('v_measured/full_s')} AS measured_fraction, {R('CASE WHEN full_day>1 THEN v_day/full_day END', 4)} AS day_fraction,
  {R('CASE WHEN full_s-full_day>1 THEN v_night/(full_s-full_day) END', 4)} AS night_fraction, CAST(v_effective AS BIGINT) AS effective_seconds FROM h""")
def d1(t):
    """Window ET with quality, day and night coverage."""
    out = iv.interval_labels(t.flux, ["station"])
    return out.select("station", day_text("target_time").alias("target_time"), day_text("target_end").alias("target_end"), r6("value").alias("value"),
                      F.array_join("reasons", ",").alias("reasons"), r6("valid_fraction").alias("valid_fraction"), r6("measured_fraction").alias("measured_fraction"),
                      r6("day_fraction", 4).alias("day_fraction"), r6("night_fraction", 4).alias("night_fraction"), F.col("effective_seconds").cast("bigint").alias("effective_seconds"))


@query("D2_daily_support", """WITH r AS (SELECT *, (le IS NOT NULL AND qc IN (0,1)) AS good, start_s // 86400 AS d FROM @flux f),
 s AS (SELECT *, sum(CASE WHEN good THEN end_s - start_s ELSE 0 END) OVER (PARTITION BY station, d) AS sec FROM r)
 SELECT station, CAST(d AS BIGINT) AS day, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows, CAST(sum(CASE WHEN good AND sec >= 0.75*86400 THEN 1 ELSE 0 END) AS BIGINT) AS kept_rows FROM s GROUP BY 1, 2""")
def d2(t):
    """Rows of days with enough valid seconds."""
    f = t.flux
    good = F.col("le").isNotNull() & F.col("qc").isin(0, 1)
    out = iv.daily_support(f.withColumn("good", good), ["station"], F.col("good"), "kept")
    return out.groupBy("station", F.floor(F.col("start_s") / 86400).alias("day")).agg(
        F.sum(F.col("good").cast("int")).alias("valid_rows"), F.sum(F.col("kept").cast("int")).alias("kept_rows"))


def _paired_sql() -> str:
    ok = "(le IS NOT NULL AND qc IN (0,1))"
    okc = "(le IS NOT NULL AND le_corr IS NOT NULL AND qc IN (0,1))"
    cols = ", ".join([f"{R(VALUE(p))} AS {n}" for p, n in (("raw", "raw_value"), ("cor", "corrected_value"), ("mat", "raw_matched_value"))])
    return f"""WITH {SUN}, mid AS (SELECT *, (start_s // 86400 + 1)*86400 AS m FROM @flux f),
 loc AS (SELECT * REPLACE (least(end_s, m) AS end_s) FROM mid UNION ALL SELECT * REPLACE (m AS start_s) FROM mid WHERE end_s > m),
 sup AS (SELECT *, {ok} AND sum(CASE WHEN {ok} THEN end_s-start_s ELSE 0 END) OVER (PARTITION BY station, start_s//86400) >= 0.75*86400 AS rm,
   {okc} AND sum(CASE WHEN {okc} THEN end_s-start_s ELSE 0 END) OVER (PARTITION BY station, start_s//86400) >= 0.75*86400 AS cm FROM loc),
 utc AS (SELECT * REPLACE (start_s - offset_s AS start_s, end_s - offset_s AS end_s) FROM sup),
 rows AS (SELECT * FROM {WITH_DAY(TOUCH('utc'))}),
 sums AS (SELECT station, target_time, {LABELS('le', 'rm AND qc IN (0,1)', 'raw')}, {LABELS('le_corr', 'cm AND qc IN (0,1)', 'cor')}, {LABELS('le', 'cm AND qc IN (0,1)', 'mat')} FROM rows GROUP BY ALL),
 {SPINE}, {ON_SPINE('raw', 'cor', 'mat')},
 h AS (SELECT *, CAST({E('target_end')} - {E('target_time')} AS DOUBLE) AS full_s, {FULL_DAY} AS full_day FROM g)
 SELECT station, {D('target_time')} AS target_time, {cols}, {REASONS('raw', 0, 0.5, 0.75)} AS raw_reasons, {REASONS('cor', 0, 0.5, 0.75)} AS corrected_reasons,
  {R('cor_effective/full_s')} AS corrected_valid_fraction FROM h"""


@query("D3_window_triplet", _paired_sql())
def d3(t):
    """Raw, corrected and matched labels of the same windows."""
    out = iv.paired_labels(t.flux, ["station"], "offset_s")
    return out.select("station", day_text("target_time").alias("target_time"), r6("raw_value").alias("raw_value"), r6("corrected_value").alias("corrected_value"),
                      r6("raw_matched_value").alias("raw_matched_value"), "raw_reasons", "corrected_reasons", r6("corrected_valid_fraction").alias("corrected_valid_fraction"))


def _closure_sql() -> str:
    parts = []
    for mode in iv.ENERGY_MODES:
        codes = "(0,1)" if "goodfill" in mode else "(0)"
        cond = f"netrad IS NOT NULL AND le IS NOT NULL AND h IS NOT NULL AND g IS NOT NULL AND le_qc IN {codes} AND h_qc IN {codes} AND g_qc IN {codes}"
        if mode.endswith("_day"):
            cond += f" AND sw_in > 20 AND sw_in_qc IN {codes}"
        parts.append(f"""SELECT station, '{mode}' AS mode, coalesce(sum(CASE WHEN {cond} THEN (le+h)*(end_s-start_s) END),0) AS num, coalesce(sum(CASE WHEN {cond} THEN (netrad-g)*(end_s-start_s) END),0) AS den,
   count(CASE WHEN {cond} THEN 1 END) AS n, coalesce((max(CASE WHEN {cond} THEN start_s END) - min(CASE WHEN {cond} THEN start_s END))/86400.0, 0) AS span FROM @flux f GROUP BY station""")
    return f"""SELECT station, mode, {R('CASE WHEN den > 0 THEN num/den END')} AS ebr, n AS valid_intervals, {R('span')} AS common_span_days,
  CASE WHEN span <= 365.25 THEN 'insufficient_record_span' WHEN den <= 0 THEN 'unassessable_energy' WHEN num/den > 0.75 THEN 'pass' ELSE 'fail' END AS status FROM ({' UNION ALL '.join(parts)}) u"""


@query("D4_energy_closure", _closure_sql())
def d4(t):
    """Energy balance ratio in four modes from one pass."""
    out = iv.energy_closure(t.flux, "station")
    return out.select("station", "mode", r6("ebr").alias("ebr"), "valid_intervals", r6("common_span_days").alias("common_span_days"), "status")


@query("D5_bowen_preservation", f"""WITH e AS (SELECT station, abs(h_corr*le - h*le_corr)/(abs(h_corr*le)+abs(h*le_corr)) AS x FROM @flux f WHERE abs(h_corr*le)+abs(h*le_corr) > 1)
 SELECT station, count(*) AS intervals, {R('quantile_cont(x, 0.5)')} AS median, {R('quantile_cont(x, 0.95)')} AS p95 FROM e GROUP BY station""")
def d5(t):
    """Exact percentiles of the corrected-flux error."""
    out = iv.bowen_preservation(t.flux, ["station"])
    return out.select("station", "intervals", r6("median").alias("median"), r6("p95").alias("p95"))


_MORN = f"""m AS (SELECT sensor, lon, t_s, value, CAST(round((t_s - (21600.0 - lon*240))/86400.0) AS BIGINT) AS d, good FROM @sensor s),
 i AS (SELECT *, d*86400 + 21600.0 - lon*240 AS ideal FROM m WHERE good AND value BETWEEN 0 AND 1),
 w AS (SELECT *, {W0('CAST(make_timestamp(CAST(floor(ideal) AS BIGINT)*1000000) AS DATE)')} AS target_time, {W0('CAST(make_timestamp(t_s*1000000) AS DATE)')} AS tw FROM i WHERE abs(t_s - ideal) <= 3600),
 pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor, d, target_time ORDER BY abs(t_s-ideal), t_s, value) AS rn FROM w WHERE tw = target_time) x WHERE rn = 1)"""


@query("C5_nearest_morning", f"WITH {_MORN} SELECT sensor, {D('CAST(make_timestamp(d*86400*1000000) AS DATE)')} AS solar_date, t_s AS utc, {R('value')} AS value, {R('t_s-ideal')} AS offset_seconds FROM pick")
def c5(t):
    """Nearest good reading to solar 06:00 of each day."""
    out = iv.nearest_mornings(t.sensor, ["sensor"])
    return out.select("sensor", day_text("solar_date").alias("solar_date"), "utc", r6("value").alias("value"), r6("offset_seconds").alias("offset_seconds"))


@query("D6_morning_mean", f"""WITH {_MORN}, u AS (SELECT sensor, target_time, avg(value) AS value, count(*) AS valid_days FROM pick GROUP BY ALL),
 x AS (SELECT sensor, lon, min({W0('CAST(make_timestamp(t_s*1000000) AS DATE)')}) AS lo, max({W0('CAST(make_timestamp(t_s*1000000) AS DATE)')}) AS hi FROM @sensor s GROUP BY ALL),
 c AS (SELECT CAST(make_date(CAST(y AS INT), 1, 1) + CAST(8*k AS INTEGER) AS DATE) AS target_time FROM range(2022, 2027) r(y), range(0, 46) s(k)),
 g AS (SELECT x.sensor, x.lon, c.target_time, u.value, coalesce(u.valid_days, 0) AS valid_days FROM x JOIN c ON c.target_time BETWEEN lo AND hi LEFT JOIN u ON u.sensor = x.sensor AND u.target_time = c.target_time),
 e AS (SELECT *, CAST(ceil(({E(W1('target_time'))} - (21600.0-lon*240))/86400.0) - ceil(({E('target_time')} - (21600.0-lon*240))/86400.0) AS BIGINT) AS expected_days FROM g)
 SELECT sensor, {D('target_time')} AS target_time, {R('value')} AS value, valid_days, expected_days, valid_days > 0 AND valid_days >= 0.8*expected_days AS valid FROM e""")
def d6(t):
    """Window means of the chosen mornings, windows without a morning included."""
    readings = t.sensor.withColumn("until_s", F.col("t_s") + 1)
    spine = iv.window_spine(readings, ["sensor", "lon"], "t_s", "until_s")
    out = iv.morning_means(iv.nearest_mornings(readings, ["sensor"]), ["sensor"], spine=spine)
    return out.select("sensor", day_text("target_time").alias("target_time"), r6("value").alias("value"), "valid_days", "expected_days", "valid")


@query("I6_expected_mornings", f"""WITH s AS (SELECT DISTINCT sensor, lon FROM @sensor s), w AS (SELECT CAST(DATE '2024-01-01' + CAST(8*i AS INTEGER) AS DATE) AS a FROM range(0, 5) r(i))
 SELECT sensor, {D('a')} AS target_time, CAST(ceil(({E('a + 8')} - (21600.0-lon*240))/86400.0) - ceil(({E('a')} - (21600.0-lon*240))/86400.0) AS BIGINT) AS expected_days FROM s, w""")
def i6(t):
    """Solar-morning count of every sensor and window."""
    s = t.sensor.select("sensor", "lon").distinct()
    rows = cal.windows_between(s.withColumn("a", F.lit("2024-01-01").cast("date")).withColumn("b", F.lit("2024-02-10").cast("date")), F.col("a"), F.col("b"))
    n = iv.expected_mornings(cal.epoch(F.col("target_time")), cal.epoch(F.col("target_end")), F.col("lon"))
    return rows.select("sensor", day_text("target_time").alias("target_time"), n.alias("expected_days"))


@query("D7_daily_then_window_mean", f"""WITH d AS (SELECT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day, avg(value) AS v FROM @sensor s WHERE good GROUP BY ALL)
 SELECT sensor, {D(W0('day'))} AS target_time, {R('avg(v)', 9)} AS value, count(*) AS days FROM d GROUP BY ALL""")
def d7(t):
    """One vote per UTC day."""
    day = F.timestamp_seconds("t_s").cast("date")
    d = t.sensor.filter("good").groupBy("sensor", day.alias("day")).agg(F.avg("value").alias("v"))
    out = d.groupBy("sensor", cal.window_start(F.col("day")).alias("w")).agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("days"))
    return out.select("sensor", day_text("w").alias("target_time"), r6("value", 9).alias("value"), "days")


@query("D11_rejection_histogram", """SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN qc = 2 THEN 'error_only' END, CASE WHEN le_corr IS NULL THEN 'no_correction' END, CASE WHEN netrad IS NULL THEN 'no_radiation' END]) AS reason FROM @flux f) r WHERE reason IS NOT NULL GROUP BY 1""")
def d11(t):
    """Rejection reasons exploded and counted."""
    reasons = F.array_compact(F.array(F.when(F.col("qc") == 2, "error_only"), F.when(F.col("le_corr").isNull(), "no_correction"), F.when(F.col("netrad").isNull(), "no_radiation")))
    return t.flux.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("C4_asof_backward", f"""WITH p AS (SELECT event_id AS obs_id, user_id AS sensor, CAST(floor(epoch(ts)) AS BIGINT) AS t_s FROM events WHERE event_type = 'purchase'),
 j AS (SELECT p.*, h.event_s, h.height, row_number() OVER (PARTITION BY obs_id ORDER BY h.event_s DESC, h.event_id DESC) AS rn FROM p LEFT JOIN @history h ON h.sensor = p.sensor AND h.event_s <= p.t_s)
 SELECT obs_id, sensor, CASE WHEN t_s - event_s <= 5*86400 THEN event_s END AS event_s, {R('CASE WHEN t_s - event_s <= 5*86400 THEN height END')} AS height FROM j WHERE rn = 1""")
def c4(t):
    """Last dated update at or before each observation; a NULL update invalidates, old ones expire."""
    obs = t.sql("SELECT event_id AS obs_id, user_id AS sensor, unix_seconds(CAST(ts AS TIMESTAMP)) AS t_s FROM $events WHERE event_type = 'purchase'")
    out = ordered.asof_backward(obs, t.history, ["sensor"], "t_s", "event_s", ["height"], tie=["event_id"], max_age=5 * 86400)
    return out.select("obs_id", "sensor", "event_s", r6("height").alias("height"))


@query("C6_interval_overlap", f"""SELECT station, {D('target_time')} AS target_time, CAST(sum(greatest(0, right_s-left_s)) AS BIGINT) AS overlap_s, count(*) AS intervals FROM
 {TOUCH("(SELECT station, start_s + 86400*6 - 900 AS start_s, end_s + 86400*6 - 900 AS end_s FROM @flux f)")} GROUP BY ALL""")
def c6(t):
    """Seconds of every interval inside every window it meets; the shifted series straddles boundaries."""
    f = t.flux.select("station", (F.col("start_s") + 86400 * 6 - 900).alias("start_s"), (F.col("end_s") + 86400 * 6 - 900).alias("end_s"))
    out = iv.touch_windows(f).groupBy("station", "target_time").agg(F.sum("overlap_s").alias("overlap_s"), F.count(F.lit(1)).alias("intervals"))
    return out.select("station", day_text("target_time").alias("target_time"), "overlap_s", "intervals")


@query("C7_interval_daylight", f"WITH {SUN} SELECT station, CAST(start_s // 86400 AS BIGINT) AS day, {R('sum(day_s)', 3)} AS daylight_s FROM {WITH_DAY('(SELECT *, start_s AS left_s, end_s AS right_s FROM @flux f)')} GROUP BY ALL")
def c7(t):
    """Daylight seconds of every interval."""
    out = iv.with_daylight(t.flux, "start_s", "end_s")
    return out.groupBy("station", F.floor(F.col("start_s") / 86400).alias("day")).agg(r6(F.sum("day_s"), 3).alias("daylight_s"))


@query("C8_exact_alignment", """WITH a AS (SELECT station, start_s, end_s, le FROM @flux f WHERE qc < 2), b AS (SELECT station, start_s, end_s, h FROM @flux f WHERE netrad IS NOT NULL)
 SELECT station, count(*) FILTER (WHERE a.le IS NOT NULL AND b.h IS NOT NULL) AS matched, count(*) FILTER (WHERE b.h IS NULL) AS missing_right, count(*) FILTER (WHERE a.le IS NULL) AS missing_left FROM a FULL JOIN b USING (station, start_s, end_s) GROUP BY station""")
def c8(t):
    """Equality on both interval bounds with the unmatched keys counted."""
    from landtally.operators import joins

    f = t.flux
    hit, miss = joins.aligned(f.filter("qc < 2").select("station", "start_s", "end_s", "le"), f.filter("netrad is not null").select("station", "start_s", "end_s", "h"), ["station", "start_s", "end_s"])
    rows = hit.select("station", F.lit("matched").alias("k")).unionByName(miss.select("station", F.concat(F.lit("missing_"), "missing_side").alias("k")))
    n = lambda k: F.count(F.when(F.col("k") == k, 1)).alias(k)
    return rows.groupBy("station").agg(n("matched"), n("missing_right"), n("missing_left"))


@query("E5_lag_step", f"""WITH s AS (SELECT sensor, t_s - lag(t_s) OVER (PARTITION BY sensor ORDER BY t_s) AS step FROM @sensor s)
 SELECT sensor, count(step) AS steps, {R('quantile_cont(CAST(step AS DOUBLE), 0.5)')} AS median_step_s FROM s WHERE step IS NOT NULL GROUP BY sensor""")
def e5(t):
    """Median spacing of each sensor."""
    out = iv.median_step(t.sensor, ["sensor"])
    return out.select("sensor", "steps", r6("median_step_s").alias("median_step_s"))


@query("E6_overlap_gap", """WITH d AS (SELECT DISTINCT sensor, CAST(make_timestamp(t_s*1000000) AS DATE) AS day FROM @sensor s), n AS (SELECT sensor, day, lead(day) OVER (PARTITION BY sensor ORDER BY day) - day AS gap FROM d)
 SELECT sensor, strftime(day, '%Y-%m-%d') AS day, CAST(gap AS BIGINT) AS gap FROM n WHERE gap < 3""")
def e6(t):
    """Successive dates closer than the gap."""
    from landtally.operators import checks

    s = t.sensor.select("sensor", F.timestamp_seconds("t_s").cast("date").alias("day"))
    out = checks.close_dates(s, ["sensor"], "day", 3)
    return out.select("sensor", day_text("day").alias("day"), F.col("gap").cast("bigint").alias("gap"))


@query("L6_interval_series", """WITH f AS (SELECT station, start_s, end_s + CASE WHEN start_s % 36000 = 0 THEN 900 WHEN start_s % 50400 = 0 THEN 4000 ELSE 0 END AS end_s FROM @flux f), n AS (SELECT *, lead(start_s) OVER (PARTITION BY station ORDER BY start_s) AS nx FROM f)
 SELECT station, start_s, CASE WHEN end_s <= start_s THEN 'nonpositive' WHEN end_s - start_s > 3600 THEN 'longer_than_hour' ELSE 'overlap' END AS reason FROM n WHERE end_s <= start_s OR end_s - start_s > 3600 OR nx < end_s""")
def l6(t):
    """Intervals that are not positive, too long, or overlap their successor."""
    late = F.when(F.col("start_s") % 36000 == 0, 900).when(F.col("start_s") % 50400 == 0, 4000).otherwise(0)
    f = t.flux.select("station", "start_s", (F.col("end_s") + late).alias("end_s"))
    return iv.interval_violations(f, ["station"]).select("station", "start_s", "reason")


@query("E8_merged_spans", """WITH s AS (SELECT sensor, t_s AS a, t_s + 21600 AS b FROM @sensor s), r AS (SELECT *, max(b) OVER (PARTITION BY sensor ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
 SELECT sensor, min(a) AS span_left, max(b) AS span_right FROM i GROUP BY sensor, island""")
def e8(t):
    """Union of touching spans."""
    s = t.sensor.select("sensor", F.col("t_s").alias("span_left"), (F.col("t_s") + 21600).alias("span_right"))
    return iv.merged_spans(s, ["sensor"], "span_left", "span_right")


@query("I1_calendar_windows", f"""WITH y AS (SELECT sensor, min(CAST(make_timestamp(t_s*1000000) AS DATE)) - 40 AS a, max(CAST(make_timestamp(t_s*1000000) AS DATE)) + 20 AS b FROM @sensor s GROUP BY 1),
 c AS (SELECT CAST(make_date(yr,1,1) + CAST(8*i AS INTEGER) AS DATE) AS w, yr FROM (VALUES (2023),(2024)) v(yr), range(0,46) r(i)), k AS (SELECT w, least(CAST(w+8 AS DATE), make_date(yr+1,1,1)) AS e FROM c WHERE year(w) = yr)
 SELECT sensor, {D('w')} AS target_time, {D('e')} AS target_end FROM y JOIN k ON w >= a AND e <= b AND w + 24 <= DATE '2024-02-20'""")
def i1(t):
    """Calendar windows inside each sensor's record whose context has ended."""
    day = F.timestamp_seconds("t_s").cast("date")
    y = t.sensor.groupBy("sensor").agg(F.date_sub(F.min(day), 40).alias("a"), F.date_add(F.max(day), 20).alias("b"))
    out = cal.windows_between(y, F.col("a"), F.col("b")).filter(F.date_add("target_time", 24) <= F.lit("2024-02-20").cast("date"))
    return out.select("sensor", day_text("target_time").alias("target_time"), day_text("target_end").alias("target_end"))


@query("I2_periods", f"""WITH c AS (SELECT CAST(make_date(yr,1,1) + CAST(8*i AS INTEGER) AS DATE) AS w FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS yr FROM lineitem), range(0,46) r(i)), k AS (SELECT w, {W1('w')} AS e FROM c)
 SELECT {D('w')} AS target_time, {D('e')} AS target_end, ({E('w')}+{E('e')})/2 >= {E("DATE '1996-03-05'")} AND ({E('w')}+{E('e')})/2 < {E("DATE '1998-06-20'")} AS by_midpoint,
  w >= DATE '1996-03-05' AND w < DATE '1998-06-20' AS by_start FROM k WHERE w BETWEEN DATE '1996-02-01' AND DATE '1998-08-01'""")
def i2(t):
    """Windows selected by midpoint and by start."""
    years = t.lineitem.select(F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("a")).distinct()
    k = cal.windows_between(years.withColumn("b", cal.first_of_year(F.col("a"), 1)), F.col("a"), F.col("b")).select("target_time", "target_end")
    k = k.filter(F.col("target_time").between("1996-02-01", "1998-08-01")).distinct()
    mid = cal.windows_by_midpoint(t.spark, "1996-03-05", "1998-06-20").select("target_time", F.lit(True).alias("by_midpoint"))
    start = cal.windows_by_start(t.spark, "1996-03-05", "1998-06-20").select("target_time", F.lit(True).alias("by_start"))
    out = k.join(mid, "target_time", "left").join(start, "target_time", "left")
    no = F.lit(False)
    return out.select(day_text("target_time").alias("target_time"), day_text("target_end").alias("target_end"), F.coalesce("by_midpoint", no).alias("by_midpoint"), F.coalesce("by_start", no).alias("by_start"))


@query("I3_context_slots", f"""WITH d AS (SELECT DISTINCT target_time AS w FROM @manifest m), o AS (SELECT * FROM (VALUES ('centered_five',0,-16,-8),('centered_five',1,-8,0),('centered_five',2,0,8),('centered_five',3,8,16),('centered_five',4,16,24),
  ('past_four',0,-63,-47),('past_four',1,-47,-31),('past_four',2,-31,-15),('past_four',3,-15,1),('centered_four',0,-16,-8),('centered_four',1,-8,0),('centered_four',2,0,8),('centered_four',3,8,16)) v(policy, slot, a, b))
 SELECT {D('w')} AS target_time, policy, slot, {D('CAST(w + CAST(a AS INTEGER) AS DATE)')} AS slot_start, {D('CAST(w + CAST(b AS INTEGER) AS DATE)')} AS slot_end FROM d, o""")
def i3(t):
    """Context slots of every target day under the three policies."""
    d = t.manifest.select("target_time").distinct()
    parts = [cal.context_slots(d, F.col("target_time"), p).withColumn("policy", F.lit(p)) for p in cal.CONTEXT_OFFSETS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(day_text("target_time").alias("target_time"), "policy", "slot", day_text("slot_start").alias("slot_start"), day_text("slot_end").alias("slot_end"))


@query("I4_daylight_intervals", f"""WITH p AS (SELECT location_id, lon, lat*1.45 AS lat, CAST(DATE '2024-01-01' + CAST(c_custkey % 366 AS INTEGER) AS DATE) AS day FROM @stations s WHERE lon IS NOT NULL),
 s AS (SELECT location_id, {_L} AS a, {_R} AS b FROM p) SELECT location_id, {R('a', 3)} AS sun_left, {R('b', 3)} AS sun_right FROM s WHERE a IS NOT NULL""")
def i4(t):
    """Sunrise and sunset of one day per station, polar day and night included."""
    p = t.sql("SELECT location_id, lon, lat*1.45 AS lat, date_add(DATE '2024-01-01', CAST(c_custkey % 366 AS INT)) AS day FROM @stations s WHERE lon IS NOT NULL")
    out = iv.daylight_spans(p, "day", "lat", "lon")
    return out.select("location_id", r6("sun_left", 3).alias("sun_left"), r6("sun_right", 3).alias("sun_right"))


@query("I5_split_at_midnight", """WITH f AS (SELECT station, start_s + 600 AS start_s, end_s + 600 AS end_s, le, (start_s + 600)//86400*86400 + 86400 AS m FROM @flux f)
 SELECT station, start_s, least(end_s, m) AS end_s FROM f UNION ALL SELECT station, m, end_s FROM f WHERE end_s > m""")
def i5(t):
    """Intervals that cross midnight become two."""
    f = t.flux.select("station", (F.col("start_s") + 600).alias("start_s"), (F.col("end_s") + 600).alias("end_s"))
    return iv.split_at_midnight(f)


@query("I7_slot_assignment", """WITH m AS (SELECT sample_id, target_time, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) - 30 AS seen FROM @manifest m JOIN orders USING (o_orderkey)), o AS (SELECT sample_id, CAST(seen AS DATE) - target_time AS off FROM m)
 SELECT sample_id, CAST(off AS BIGINT) AS day_offset, CASE WHEN off >= -16 AND off < 24 THEN CAST((off + 16)//8 AS INTEGER) END AS slot FROM o""")
def i7(t):
    """Slot of an observation day by half-open intervals."""
    m = t.manifest.join(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "o_orderkey")
    seen = F.date_add("d", (F.col("o_orderkey") % 60 - 30).cast("int"))
    return m.select("sample_id", F.datediff(seen, "target_time").cast("bigint").alias("day_offset"), cal.assign_slot(F.col("target_time"), seen).alias("slot"))


@query("I8_metadata_events", f"""WITH v AS (SELECT user_id AS station, event_id, CASE event_id % 5 WHEN 0 THEN '90th Percentile' WHEN 1 THEN 'Maximum' ELSE 'Mean' END AS statistic,
   CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts - to_minutes(CAST(minute(ts) AS BIGINT)) - to_hours(CAST(hour(ts) % 12 AS BIGINT))) END AS stamp, event_id % 19 = 7 AS undated, round(value / 100) AS num
   FROM events WHERE event_type IN ('signup','view') AND value >= 1 AND event_id % 13 <> 5 AND event_id % 11 <> 4),
 u AS (SELECT station, CAST(floor(epoch(stamp)) AS BIGINT) - (station % 5 - 2) * 3600 AS t_s, CASE WHEN statistic = 'Mean' THEN 0 ELSE 1 END AS priority, num FROM v WHERE statistic <> 'Maximum' AND NOT undated AND num <> 3),
 p AS (SELECT *, max(priority) OVER (PARTITION BY station, t_s) AS top FROM u)
 SELECT station, t_s, CASE WHEN count(DISTINCT num) = 1 THEN {R('min(num)')} END AS value, count(DISTINCT num) > 1 AS ambiguous FROM p WHERE priority = top GROUP BY station, t_s""")
def i8(t):
    """Dated canopy heights of raw metadata rows by priority; different values at one time invalidate it."""
    from landtally.sources.metadata import CANOPY, height_groups, metadata_events

    e = t.events.filter("event_type in ('signup', 'view') and value >= 1").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    day = F.date_format("ts", "yyyyMMdd")
    half = F.concat(day, F.when(F.hour("ts") < 12, "0000").otherwise("1200"))
    cells = {"HEIGHTC": F.when(F.round(F.col("value") / 100) == 3, "-9999").otherwise(F.round(F.col("value") / 100).cast("string")),
             "HEIGHTC_STATISTIC": F.when(k % 5 == 0, "90th Percentile").when(k % 5 == 1, "Maximum").otherwise("Mean"),
             "HEIGHTC_DATE": F.when(k % 19 == 7, F.date_format("ts", "yyyyMM")).when(k % 3 == 0, day).otherwise(half),
             "HEIGHTC_SPP": F.when(k % 13 == 5, "species"), "HEIGHTC_VEG_STATUS": F.when(k % 11 == 4, "Dead").when(k % 11 == 5, "Alive")}
    long = e.select(F.col("user_id").alias("station"), (F.col("user_id") % 5 - 2).alias("offset_h"), k.alias("GROUP_ID"), F.lit(CANOPY).alias("VARIABLE_GROUP"), F.explode(
        F.array(*[F.struct(F.lit(n).alias("n"), c.alias("v")) for n, c in cells.items()])).alias("c")).filter("c.v is not null")
    long = long.select("station", "offset_h", "GROUP_ID", "VARIABLE_GROUP", F.col("c.n").alias("VARIABLE"), F.col("c.v").alias("DATAVALUE"))
    out = metadata_events(height_groups(long, ["station"], CANOPY, "offset_h"), ["station"])
    return out.select("station", "t_s", r6("value").alias("value"), "ambiguous")