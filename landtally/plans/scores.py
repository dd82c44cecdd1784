"""Queries over evaluation metrics and bootstraps (family M) and user extension points (family P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtally.functions import radiometry as rad
from landtally.operators import joins, metrics
from landtally.plans.fields import _ARG
from landtally.plans.registry import R, query, r6
from landtally.plans.relations import count, isum

LONG = "(SELECT key, task, site, station, day, year, frequency_bin, sampling_group, target, 'a' AS mode, model_a AS pred, valid_a AS valid FROM @pairs p UNION ALL SELECT key, task, site, station, day, year, frequency_bin, sampling_group, target, 'b', model_b, valid_b FROM @pairs p)"


def _long(t):
    p = t.pairs
    entry = lambda m: F.struct(F.lit(m).alias("mode"), F.col(f"model_{m}").alias("pred"), F.col(f"valid_{m}").alias("valid"))
    return p.select("key", "task", "site", "station", "day", "year", "frequency_bin", "sampling_group", "target", F.inline(F.array(entry("a"), entry("b"))))


STATS = "count(*) AS n, avg(abs(pred-target)) AS mae, sqrt(avg(pow(pred-target,2))) AS rmse, avg(pred-target) AS bias, 1 - sum(pow(pred-target,2))/(var_pop(target)*count(*)) AS r2, corr(pred,target) AS r, sqrt(greatest(0, avg(pow(pred-target,2)) - pow(avg(pred-target),2))) AS ub"


@query("M1_regression_metrics", f"SELECT task, mode, n AS count, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('bias')} AS bias, {R('r2')} AS r2, {R('ub')} AS ubrmse, {R('r')} AS correlation FROM (SELECT task, mode, {STATS} FROM {LONG} l WHERE valid GROUP BY task, mode) s")
def m1(t):
    """Regression metrics from sufficient sums."""
    out = metrics.regression_metrics(metrics.regression_sums(_long(t), ["task", "mode"], "pred", "target", F.col("valid")))
    return out.select("task", "mode", "count", *[r6(c).alias(c) for c in ("mae", "rmse", "bias", "r2", "ubrmse", "correlation")])


@query("M2_agreement", f"""WITH g AS (SELECT station, mode, task, count(*) AS n, sqrt(avg(pow(pred-target,2))) AS rmse, sum(pow(pred-target,2)) AS se, var_pop(target)*count(*) AS v, corr(pred, target) AS r FROM {LONG} l WHERE valid AND year(day) = 1997 AND dayofyear(day) < 20 GROUP BY ALL)
 SELECT rule, station, mode, task, n, {R('rmse')} AS rmse, {R('CASE WHEN v > 1e-9 THEN 1-se/v END', 4)} AS r2, {R("CASE WHEN rule = 'correlated' AND v > 1e-9 THEN r END", 4)} AS r FROM g, (VALUES ('variance'),('pairs'),('correlated')) w(rule)""")
def m2(t):
    """The three agreement rules side by side."""
    x = _long(t).filter((F.year("day") == 1997) & (F.dayofyear("day") < 20))
    sums = metrics.regression_sums(x, ["station", "mode", "task"], "pred", "target", F.col("valid"))
    parts = []
    for rule in ("variance", "pairs", "correlated"):
        a = metrics.agreement(sums, rule).withColumn("rule", F.lit(rule))
        r = F.col("r") if rule == "correlated" else F.lit(None).cast("double")
        parts.append(a.select("rule", "station", "mode", "task", "n", r6("rmse").alias("rmse"), r6("r2", 4).alias("r2"), r6(r, 4).alias("r")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("M3_scores", f"""WITH g AS (SELECT task, mode, sqrt(avg(pow(pred-target,2))) AS rmse FROM {LONG} l WHERE valid GROUP BY ALL), s AS (SELECT mode, -avg(rmse / CASE task WHEN 'sm' THEN 12.0 ELSE 15.0 END) AS sc FROM g GROUP BY mode)
 SELECT {R("max(CASE WHEN mode='a' THEN sc END)")} AS product_score, {R("max(CASE WHEN mode='b' THEN sc END)")} AS site_score, {R("(1-2/3.0)*max(CASE WHEN mode='a' THEN sc END) + 2/3.0*max(CASE WHEN mode='b' THEN sc END)")} AS joint_score FROM s""")
def m3(t):
    """Scaled product, site and joint scores."""
    out = metrics.regression_metrics(metrics.regression_sums(_long(t), ["task", "mode"], "pred", "target", F.col("valid")))
    s = metrics.scaled_score(out, ["mode"], "task", {"sm": 12.0, "et": 15.0})
    return metrics.joint_score(s, "mode", "a", "b").select(*[r6(c).alias(c) for c in ("product_score", "site_score", "joint_score")])


@query("M4_group_macro", f"WITH g AS (SELECT task, mode, site, {STATS} FROM {LONG} l WHERE valid GROUP BY ALL) SELECT task, mode, count(*) AS groups, {R('avg(rmse)')} AS rmse, {R('avg(r2)')} AS r2, count(r2) AS r2_groups FROM g GROUP BY task, mode")
def m4(t):
    """Per-site metrics, then equal-site means."""
    g = metrics.regression_metrics(metrics.regression_sums(_long(t), ["task", "mode", "site"], "pred", "target", F.col("valid")))
    out = metrics.macro_mean(g, ["task", "mode"], ["rmse", "r2"])
    return out.select("task", "mode", "groups", r6("rmse").alias("rmse"), r6("r2").alias("r2"), "r2_groups")


@query("M5_stratified_metrics", f"SELECT task, mode, frequency_bin, sampling_group, count(*) AS count, {R('sqrt(avg(pow(pred-target,2)))')} AS rmse FROM {LONG} l WHERE valid AND year BETWEEN 1996 AND 1999 GROUP BY GROUPING SETS ((task, mode, frequency_bin), (task, mode, sampling_group))")
def m5(t):
    """RMSE per bin and per group over the comparison years, in one pass."""
    e2 = F.pow(F.col("pred") - F.col("target"), F.lit(2))
    x = _long(t).filter("valid and year between 1996 and 1999")
    return x.groupingSets([["task", "mode", "frequency_bin"], ["task", "mode", "sampling_group"]], "task", "mode", "frequency_bin", "sampling_group").agg(count("count"), r6(F.sqrt(F.avg(e2))).alias("rmse")).select("task", "mode", "frequency_bin", "sampling_group", "count", "rmse")


_CM = """c AS (SELECT cls, count(*) FILTER (WHERE cover_class = cls) AS support, count(*) FILTER (WHERE predicted_class = cls) AS predicted_count, count(*) FILTER (WHERE cover_class = cls AND predicted_class = cls) AS tp FROM {src}, (VALUES (0),(1),(2)) v(cls) GROUP BY {k} cls)"""


@query("M6_confusion", "WITH " + _CM.format(src="@points p", k="") + f" SELECT cls, support, predicted_count, {R('tp/nullif(predicted_count,0)')} AS precision, {R('tp/nullif(support,0)')} AS recall, {R('2*tp/nullif(support+predicted_count,0)')} AS f1, {R('tp/nullif(support+predicted_count-tp,0)')} AS iou FROM c")
def m6(t):
    """Per class precision, recall, F1 and IoU."""
    out = metrics.class_metrics(metrics.confusion(t.points, [], "cover_class", "predicted_class"), [], "cover_class", "predicted_class")
    return out.select("cls", "support", "predicted_count", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "iou")])


_SCORED = "label_valid AND prediction_valid AND NOT training_overlap"


@query("M7_point_summary", f"""WITH conf AS (SELECT cell FROM @points p WHERE label_valid GROUP BY cell HAVING count(DISTINCT cover_class) > 1), sc AS (SELECT * FROM @points p WHERE {_SCORED}), u AS (SELECT arg_min(cover_class, point_id) AS c, arg_min(predicted_class, point_id) AS q FROM sc WHERE cell NOT IN (SELECT cell FROM conf) GROUP BY cell)
 SELECT 'total' AS item, count(*) AS n FROM @points p UNION ALL SELECT 'scored', count(*) FROM sc UNION ALL SELECT 'invalid_prediction', count(*) FROM @points p WHERE label_valid AND NOT prediction_valid UNION ALL SELECT 'training_overlap', count(*) FROM @points p WHERE training_overlap
 UNION ALL SELECT 'conflicting_cells', count(*) FROM conf UNION ALL SELECT 'unique_cells', count(*) FROM u UNION ALL SELECT 'unique_correct', count(*) FROM u WHERE c = q UNION ALL SELECT 'site:' || site_name, count(*) FROM sc GROUP BY site_name""")
def m7(t):
    """Scored points, conflicts found before any model filter, unique consistent cells, and sites."""
    return metrics.point_summary(t.points, ["cell"], "cover_class", "predicted_class", "point_id", "site_name")


def DRAWS(name: str, key: str, source: str, draws: int, seed: int) -> str:
    """CTEs of the resamples of whole groups: ``name`` has d, k and the weight w; draw 0 holds every group once."""
    u = f"((CAST(('0x' || substr(sha256('[{seed}, ' || d || ', ' || i || ']'), 1, 13)) AS BIGINT) + 1.0) / 4503599627370496.0)"
    return f"""{name}_g AS (SELECT k, row_number() OVER (ORDER BY sha256('[{seed}, ' || chr(34) || k || chr(34) || ']')) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {key} AS k FROM {source}) x),
 {name}_c AS (SELECT d, least(n, CAST(floor({u} * n) AS BIGINT) + 1) AS i, count(*) AS w FROM {name}_g, range(1, {draws + 1}) r(d) GROUP BY 1, 2),
 {name} AS (SELECT 0 AS d, k, 1 AS w FROM {name}_g UNION ALL SELECT d, k, w FROM {name}_c JOIN {name}_g USING (i))"""


def BOUNDS(value: str, names: str = "value, low, high") -> str:
    """The estimate at draw 0 and the bounds over the resamples."""
    a, b, c = (n.strip() for n in names.split(","))
    return f"""{R(f'max({value}) FILTER (d = 0)', 5)} AS {a}, {R(f'quantile_cont({value}, 0.025) FILTER (d > 0)', 5)} AS {b}, {R(f'quantile_cont({value}, 0.975) FILTER (d > 0)', 5)} AS {c}"""


_SITE_SUMS = """count(*) AS n, sum(pow(pred-target,2)) AS e, sum(pred) AS x, sum(target) AS y, sum(pred*pred) AS xx, sum(target*target) AS yy, sum(pred*target) AS xy"""
_R = "CASE WHEN yy - y*y/n > 1e-12 AND xx - x*x/n > 1e-12 THEN (xy - x*y/n)/sqrt((yy - y*y/n)*(xx - x*x/n)) END"


@query("M8_cluster_bootstrap", f"""WITH l AS (SELECT * FROM {LONG} l WHERE task = 'sm'), {DRAWS('t', 'site', 'l', 200, 20)},
 s AS (SELECT site, mode, {_SITE_SUMS} FROM l GROUP BY 1, 2),
 a AS (SELECT d, mode, sum(w*n) AS n, sum(w*e) AS e, sum(w*x) AS x, sum(w*y) AS y, sum(w*xx) AS xx, sum(w*yy) AS yy, sum(w*xy) AS xy FROM s JOIN t ON t.k = s.site GROUP BY 1, 2),
 m AS (SELECT d, mode, 'rmse' AS metric, sqrt(e/n) AS score FROM a UNION ALL SELECT d, mode, 'pearson_r', {_R} FROM a),
 c AS (SELECT m.*, m.score - b.score AS change FROM m JOIN m b ON b.d = m.d AND b.metric = m.metric AND b.mode = 'a')
 SELECT mode, metric, {R('max(score) FILTER (d = 0)', 5)} AS score, {BOUNDS('change', 'change, low, high')} FROM c GROUP BY 1, 2""")
def m8(t):
    """Change against a reference mode, resampling whole sites with shared weights."""
    out = metrics.paired_mode_bootstrap(_long(t).filter("task = 'sm'"), "site", "mode", "pred", "target", "a", 200, 20)
    return out.select("mode", "metric", *[r6(c, 5).alias(c) for c in ("score", "change", "low", "high")])


@query("M9_paired_block_bootstrap", f"""WITH l AS (SELECT * FROM {LONG} l WHERE task = 'et'), {DRAWS('t', 'site', 'l', 200, 7)},
 s AS (SELECT site, mode, {_SITE_SUMS} FROM l GROUP BY 1, 2), a AS (SELECT d, mode, sqrt(sum(w*e)/sum(w*n)) AS rmse FROM s JOIN t ON t.k = s.site GROUP BY 1, 2),
 p AS (SELECT d, max(rmse) FILTER (mode = 'a') AS a, max(rmse) FILTER (mode = 'b') AS b FROM a GROUP BY 1)
 SELECT {BOUNDS('b - a', 'difference, low, high')}, {R('max((a - b)/a) FILTER (d = 0)', 5)} AS relative_improvement FROM p""")
def m9(t):
    """RMSE difference of two arms on the same blocks, with the relative improvement."""
    out = metrics.paired_arms(_long(t).filter("task = 'et'"), "site", "mode", "pred", "target", "a", "b", 200, 7)
    return out.select(*[r6(c, 5).alias(c) for c in ("difference", "low", "high", "relative_improvement")])


@query("M10_seed_block_bootstrap", f"""WITH l AS (SELECT *, CAST(frequency_bin AS VARCHAR) AS seed FROM {LONG} l), {DRAWS('u', 'seed', 'l', 100, 11)}, {DRAWS('t', 'site', 'l', 100, 12)},
 s AS (SELECT seed, site, mode, {_SITE_SUMS} FROM l GROUP BY 1, 2, 3),
 p AS (SELECT t.d, mode, seed, max(u.w) AS ws, sum(t.w*n) AS n, sum(t.w*e) AS e FROM s JOIN t ON t.k = s.site JOIN u ON u.k = s.seed AND u.d = t.d GROUP BY 1, 2, 3),
 m AS (SELECT d, mode, sum(sqrt(e/n)*ws)/sum(ws) AS score FROM p GROUP BY 1, 2)
 SELECT mode, {BOUNDS('score')} FROM m GROUP BY 1""")
def m10(t):
    """Seeds and blocks resampled together for every arm."""
    x = _long(t).withColumn("seed", F.col("frequency_bin").cast("string"))
    out = metrics.seed_block_bootstrap(x, "seed", "site", "mode", "pred", "target", 100, 11)
    return out.select("mode", *[r6(c, 5).alias(c) for c in ("value", "low", "high")])


@query("M11_between_within", f"""WITH l AS (SELECT * FROM {LONG} l), {DRAWS('t', 'site', 'l', 100, 34)},
 v AS (SELECT task, site, station, day, mode, avg(pred) AS x, avg(target) AS y FROM l GROUP BY 1, 2, 3, 4, 5),
 st AS (SELECT task, site, station, mode, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(avg(pow(x-y,2))) AS err, var_pop(x)*count(*) AS sxx, var_pop(y)*count(*) AS syy, covar_pop(x, y)*count(*) AS sxy FROM v GROUP BY 1, 2, 3, 4),
 s AS (SELECT task, site, mode, count(*) AS many, sum(n) AS wins, sum(mx) AS bx, sum(my) AS y, sum(mx*mx) AS bxx, sum(my*my) AS byy, sum(mx*my) AS bxy, sum(err) AS err, sum(CASE WHEN n >= 2 THEN sxx ELSE 0 END) AS wxx,
   sum(CASE WHEN n >= 2 THEN syy ELSE 0 END) AS wyy, sum(CASE WHEN n >= 2 THEN sxy ELSE 0 END) AS wxy FROM st GROUP BY 1, 2, 3),
 a AS (SELECT d, task, mode, sum(w*many) AS n, sum(w*wins) AS wins, sum(w*bx) AS x, sum(w*y) AS y, sum(w*bxx) AS xx, sum(w*byy) AS yy, sum(w*bxy) AS xy, sum(w*err) AS err, sum(w*wxx) AS wxx, sum(w*wyy) AS wyy, sum(w*wxy) AS wxy
   FROM s JOIN t ON t.k = s.site GROUP BY 1, 2, 3),
 m AS (SELECT d, task, mode, n, wins, 'between_r' AS metric, {_R} AS score FROM a UNION ALL SELECT d, task, mode, n, wins, 'within_r', CASE WHEN wxx > 0 AND wyy > 0 THEN wxy/sqrt(wxx*wyy) END FROM a
   UNION ALL SELECT d, task, mode, n, wins, 'macro_rmse', err/n FROM a),
 c AS (SELECT m.*, m.score - b.score AS change FROM m LEFT JOIN m b ON b.d = m.d AND b.task = m.task AND b.metric = m.metric AND b.mode = 'a')
 SELECT task, mode, metric, {BOUNDS('score')}, {BOUNDS('change', 'change, change_low, change_high')}, CAST(max(n) FILTER (d = 0) AS BIGINT) AS stations, CAST(max(wins) FILTER (d = 0) AS BIGINT) AS windows FROM c GROUP BY 1, 2, 3""")
def m11(t):
    """Between-station and within-station skill and its change against a reference mode, with site-clustered bounds."""
    x = _long(t).select("task", "site", "station", F.col("day").alias("date"), "mode", "pred", "target")
    out = metrics.station_skill(x, "mode", 100, 34, "a", ["task"])
    return out.select("task", "mode", "metric", *[r6(c, 5).alias(c) for c in ("value", "low", "high", "change", "change_low", "change_high")], "stations", "windows")


@query("M12_best_epoch", f"""WITH e AS (SELECT s_nationkey AS run, s_suppkey AS epoch, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE round(s_acctbal/1000) END AS score FROM supplier), b AS (SELECT run, max(score) AS score FROM e GROUP BY run)
 SELECT e.run, min(epoch) AS epoch, {R('min(e.score)')} AS score FROM e JOIN b ON e.run = b.run AND e.score = b.score GROUP BY e.run""")
def m12(t):
    """Best finite score per run from JSON lines; broken lines are skipped."""
    e = t.supplier.select(F.when(F.col("s_suppkey") % 9 == 0, F.lit('{"run": 1, "epo')).otherwise(F.to_json(F.struct(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("epoch"), F.round(F.col("s_acctbal") / 1000).alias("score")))).alias("line"))
    out = metrics.best_epoch(metrics.parse_epochs(e, "line"), "run", "epoch", "score")
    return out.select(F.col("run").cast("int").alias("run"), "epoch", r6("score").alias("score"))


@query("M13_split_report", "SELECT frequency_bin, split, count(*) AS windows, count(DISTINCT physical_group_id) AS physical_sites, count(DISTINCT spatial_group_id) AS spatial_groups, CAST(sum(valid_sm) AS BIGINT) AS sm_windows, CAST(sum(valid_et) AS BIGINT) AS et_windows FROM @candidates c GROUP BY 1, 2")
def m13(t):
    """Windows, sites and groups by bin and split."""
    return t.candidates.groupBy("frequency_bin", "split").agg(count("windows"), F.countDistinct("physical_group_id").alias("physical_sites"), F.countDistinct("spatial_group_id").alias("spatial_groups"), F.sum("valid_sm").alias("sm_windows"), F.sum("valid_et").alias("et_windows"))


@query("M14_window_macro_rmse", f"WITH w AS (SELECT mode, station, day, avg(pow(pred-target,2)) AS m FROM {LONG} l WHERE valid GROUP BY ALL) SELECT mode, count(*) AS windows, {R('sqrt(avg(m))')} AS macro_rmse FROM w GROUP BY mode")
def m14(t):
    """Root of the mean window error."""
    w = _long(t).filter("valid").groupBy("mode", "station", "day").agg(F.avg(F.pow(F.col("pred") - F.col("target"), F.lit(2))).alias("m"))
    return w.groupBy("mode").agg(count("windows"), r6(F.sqrt(F.avg("m"))).alias("macro_rmse"))


@query("M15_diagnostic_tables", f"SELECT task, l_returnflag AS variant, {R('max(abs(model_b-target))')} AS max_delta, {R('quantile_cont(model_b-target, 0.5)')} AS median_delta, {R('avg(CASE WHEN model_a < target THEN 1.0 ELSE 0 END)')} AS negative_share FROM @pairs p GROUP BY 1, 2")
def m15(t):
    """Greatest change, exact median and negative share per variant and task."""
    from landtally.operators.ordered import exact_percentiles

    p = t.pairs.withColumn("delta", F.col("model_b") - F.col("target"))
    a = p.groupBy("task", "l_returnflag").agg(F.max(F.abs("delta")).alias("m"), F.avg(F.when(F.col("model_a") < F.col("target"), 1.0).otherwise(0.0)).alias("s"))
    q = exact_percentiles(p, ["task", "l_returnflag"], "delta", [0.5])
    return a.join(q, ["task", "l_returnflag"]).select("task", F.col("l_returnflag").alias("variant"), r6("m").alias("max_delta"), r6("percentile").alias("median_delta"), r6("s").alias("negative_share"))


@query("M16_cover_threshold_audit", f"WITH {_ARG}, k AS (SELECT *, rule, CASE rule WHEN 'standard' THEN water OR snow_ice OR land WHEN 'loose' THEN (win=0 AND pw>=0.2) OR (pi>=0.4) OR (pl>=0.7 AND pw<0.2 AND pi<0.2) END AS known FROM s, (VALUES ('standard'),('loose')) v(rule)) SELECT label, rule, count(*) AS cells, CAST(sum(CASE WHEN known THEN 1 ELSE 0 END) AS BIGINT) AS known_cells, {R('avg(CASE WHEN known THEN 0.0 ELSE 1 END)')} AS mean_unknown FROM k GROUP BY label, rule")
def m16(t):
    """Known cells and unknown share under each rule set."""
    p = t.probabilities.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("p"))
    rules = {"standard": {}, "loose": dict(water_min=0.2, ice_min=0.4, land_min=0.7, other_max=0.2)}
    x = p.select("label", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), rad.cover_state(F.col("p"), **a)["known"].alias("known")) for n, a in rules.items()])))
    return x.groupBy("label", "rule").agg(count("cells"), isum("known", "known_cells"), r6(F.avg(F.when(F.col("known"), 0.0).otherwise(1.0))).alias("mean_unknown"))


@query("M17_predictions_at_points", """WITH q AS (SELECT vec_id, max(CASE WHEN pos=0 THEN p END) AS w, sum(CASE WHEN pos BETWEEN 1 AND 7 THEN p ELSE 0 END) AS l, max(CASE WHEN pos=8 THEN p END) AS i FROM @probabilities q GROUP BY vec_id)
 SELECT point_id, coalesce(w + l + i BETWEEN 0.99 AND 1.01, FALSE) AS prediction_valid, CASE WHEN w >= i AND w >= l THEN 0 WHEN i >= l THEN 1 WHEN l IS NOT NULL THEN 2 END AS predicted FROM @points p LEFT JOIN q ON p.point_id = q.vec_id""")
def m17(t):
    """Predicted fractions and class at each point; unmatched points stay, invalid."""
    p = F.col("p")
    q = t.probabilities.groupBy("vec_id").agg(F.max(F.when(F.col("pos") == 0, p)).alias("w"), F.max(F.when(F.col("pos") == 8, p)).alias("i"), F.sum(F.when(F.col("pos").between(1, 7), p).otherwise(0.0)).alias("l"))
    return metrics.predictions_at_points(t.points.withColumn("vec_id", F.col("point_id")), q, ["vec_id"], ["w", "i", "l"]).select("point_id", "prediction_valid", "predicted")


@query("M18_common_sm", f"SELECT mode, scope, count(*) AS n, {R('sqrt(avg(pow(pred-target,2)))')} AS rmse FROM (SELECT mode, pred, target, unnest(CASE WHEN both_ok THEN ['common','own'] ELSE ['own'] END) AS scope FROM (SELECT l.*, k.key IS NOT NULL AS both_ok FROM {LONG} l LEFT JOIN (SELECT key FROM @pairs p WHERE valid_a AND valid_b) k ON l.key = k.key WHERE valid AND task = 'sm') x) y GROUP BY 1, 2")
def m18(t):
    """Metrics on each run's own support and on the common one."""
    x = _long(t).filter("valid and task = 'sm'")
    keys = joins.common_support(x, "key", "mode", F.lit(True), 2).withColumn("_c", F.lit(1))
    y = x.join(keys, "key", "left").select("mode", "pred", "target", F.explode(F.when(F.col("_c") == 1, F.array(F.lit("common"), F.lit("own"))).otherwise(F.array(F.lit("own")))).alias("scope"))
    s = metrics.regression_metrics(metrics.regression_sums(y, ["mode", "scope"], "pred", "target"))
    return s.select("mode", "scope", F.col("count").alias("n"), r6("rmse").alias("rmse"))


# --- P ------------------------------------------------------------------------------------------

@query("P1_label_specs", "SELECT l_returnflag AS label, violation, count(*) AS n FROM (SELECT l_returnflag, unnest([CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity > 45 THEN 'bounds' END WHEN 'R' THEN CASE WHEN l_quantity < 5 THEN 'bounds' END WHEN 'N' THEN 'unregistered' END]) AS violation FROM lineitem) x WHERE violation IS NOT NULL GROUP BY 1, 2")
def p1(t):
    """User label specs joined as a small table; unknown labels and bound violations counted."""
    from landtally.functions.specs import resolve, spec_table

    specs = resolve({"A": dict(units="1", low=0.0, high=45.0), "R": dict(units="1", low=5.0, high=60.0)})
    s = F.broadcast(spec_table(t.spark, specs))
    x = t.lineitem.select(F.col("l_returnflag").alias("label"), "l_quantity").join(s, "label", "left")
    v = F.when(F.col("units").isNull(), "unregistered").when(~F.col("l_quantity").between(F.col("low"), F.col("high")), "bounds")
    return x.select("label", v.alias("violation")).filter("violation is not null").groupBy("label", "violation").agg(count())
