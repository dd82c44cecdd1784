"""Evaluation metrics from mergeable sums, class metrics, and hash-derived cluster bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landtally.functions import keys as K

SUMS = ("count", "sum_abs", "sum_sq", "sum_err", "sum_y", "sum_y2", "sum_x", "sum_x2", "sum_xy")


def regression_sums(df: DataFrame, keys: list[str], pred: str, target: str, valid: Column | None = None) -> DataFrame:
    """Sufficient sums per group; sums of sums merge, so they fit any incremental job."""
    x, y = F.col(pred), F.col(target)
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    if valid is not None:
        ok = ok & valid
    e = x - y
    return df.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.abs(e)).alias("sum_abs"), F.sum(e * e).alias("sum_sq"), F.sum(e).alias("sum_err"),
        F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_x2"), F.sum(x * y).alias("sum_xy"))


def merge_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def regression_metrics(sums: DataFrame) -> DataFrame:
    n = F.col("count")
    mse, bias = F.col("sum_sq") / n, F.col("sum_err") / n
    vy = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / n
    vx = F.col("sum_x2") - F.col("sum_x") * F.col("sum_x") / n
    cov = F.col("sum_xy") - F.col("sum_x") * F.col("sum_y") / n
    r = F.when((vy > 1e-12) & (vx > 1e-12), cov / F.sqrt(vy * vx))
    r2 = F.when((n > 1) & (vy > F.greatest(F.col("sum_y2"), F.lit(1.0)) * 1e-12), 1 - F.col("sum_sq") / vy)
    drop = [c for c in SUMS if c != "count"]
    return sums.select("*", (F.col("sum_abs") / n).alias("mae"), F.sqrt(mse).alias("rmse"), bias.alias("bias"), r2.alias("r2"),
                       F.sqrt(F.greatest(F.lit(0.0), mse - bias * bias)).alias("ubrmse"), r.alias("correlation")).drop(*drop)


def agreement(sums: DataFrame, rule: str) -> DataFrame:
    """n, r2, rmse, mae, bias under one of the three NULL rules of r2.

    ``variance``: target variance above zero; ``pairs``: more than one pair as well;
    ``correlated``: also reports r, defined where the product of variances is not zero.
    """
    n = F.col("count")
    vy = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / n
    vx = F.col("sum_x2") - F.col("sum_x") * F.col("sum_x") / n
    cov = F.col("sum_xy") - F.col("sum_x") * F.col("sum_y") / n
    base = 1 - F.col("sum_sq") / vy
    rules = {"variance": vy > 0, "pairs": (vy > 0) & (n > 1), "correlated": vy > 0}
    out = [F.when(rules[rule], base).alias("r2"), F.sqrt(F.col("sum_sq") / n).alias("rmse"),
           (F.col("sum_abs") / n).alias("mae"), (F.col("sum_err") / n).alias("bias")]
    if rule == "correlated":
        den = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
        out.append(F.when(den > 0, cov / den).alias("r"))
    keys = [c for c in sums.columns if c not in SUMS]
    return sums.select(*keys, n.alias("n"), *out)


def macro_mean(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Equal-group means over defined values, with the number of groups behind each."""
    out = []
    for m in metrics:
        ok = F.when(F.col(m).isNotNull() & ~F.isnan(m), F.col(m))
        out += [F.avg(ok).alias(m), F.count(ok).alias(f"{m}_groups")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), *out)


def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame, keys: list[str], truth: str, predicted: str, classes: int = 3) -> DataFrame:
    """Per class support, precision, recall, F1 and IoU; undefined ratios are NULL."""
    cell = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    entries = [F.struct(
        F.lit(c).alias("cls"), cell((F.col(truth) == c) & (F.col(predicted) == c)).alias("tp"),
        cell(F.col(truth) == c).alias("support"), cell(F.col(predicted) == c).alias("predicted_count")) for c in range(classes)]
    rows = matrix.groupBy(*keys).agg(F.array(*entries).alias("_c")).select(*keys, F.inline("_c"))
    tp, a, e = F.col("tp").cast("double"), F.col("support"), F.col("predicted_count")
    return rows.select(*keys, "cls", "support", "predicted_count", F.try_divide(tp, e).alias("precision"), F.try_divide(tp, a).alias("recall"),
                       F.try_divide(tp * 2, a + e).alias("f1"), F.try_divide(tp, a + e - F.col("tp")).alias("iou"), F.col("tp"))


def class_summary(per_class: DataFrame, keys: list[str]) -> DataFrame:
    return per_class.groupBy(*keys).agg(
        F.sum("support").alias("count"), F.avg("f1").alias("macro_f1"), F.count("f1").alias("macro_f1_defined_classes"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"))


def conflicting_cells(df: DataFrame, cell: list[str], label: str) -> DataFrame:
    """Cells whose valid human labels disagree; decided before any model filter."""
    return df.groupBy(*cell).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a <> _b").select(*cell)


# --- bootstrap ----------------------------------------------------------------------------------

def group_draws(groups: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """How often each whole group is drawn in each resample: columns draw, key, weight.

    Draw 0 holds every group once. The others pick n groups of n with replacement by hash. The
    table covers groups and draws, never rows.
    """
    indexed = groups.select(key).distinct()
    hashed = indexed.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    from landtally.operators.ordered import numbered_by_hash

    ranked = numbered_by_hash(hashed, [], "_hash", "_i").select(key, F.col("_i").cast("bigint").alias("_i"))
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    # pick p of draw d is group 1 + floor(u * n), u from the hash of (seed, d, p)
    picks = ranked.select(F.col("_i").alias("_p"), size.scalar().alias("_n")).withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = K.hash_unit(K.fingerprint(seed, F.col("draw"), F.col("_p")))
    chosen = picks.select("draw", F.least(F.col("_n"), F.floor(u * F.col("_n")) + 1).alias("_i")).groupBy("draw", "_i").agg(
        F.count(F.lit(1)).alias("weight"))
    whole = ranked.select(F.lit(0).alias("draw"), "_i", F.lit(1).cast("bigint").alias("weight"))
    return whole.unionByName(chosen).join(ranked, "_i").select("draw", key, "weight")


def bootstrap_sums(group_sums: DataFrame, draws: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """Weighted sums per draw from per-group sums."""
    j = group_sums.join(draws, key)
    return j.groupBy("draw", *by).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])


def interval_of(df: DataFrame, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Estimate at draw 0 and percentile bounds over the resamples (a bounded number of draws)."""
    v = F.col(value)
    spread = F.percentile(F.when(F.col("draw") > 0, v), F.array(F.lit(low), F.lit(high)))
    return df.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, v)).alias("value"), spread.alias("_q")).select(
        *keys, "value", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def paired_mode_bootstrap(df: DataFrame, site: str, mode: str, pred: str, target: str, reference: str, draws: int, seed: int) -> DataFrame:
    """Change of RMSE and correlation against a reference mode, resampling whole sites with shared weights."""
    sums = regression_sums(df, [site, mode], pred, target)
    table = group_draws(df, site, draws, seed)
    total = bootstrap_sums(sums, table, site, [mode], list(SUMS))
    scored = regression_metrics(total).select("draw", mode, F.col("rmse"), F.col("correlation"))
    long = scored.select("draw", mode, F.expr("stack(2, 'rmse', rmse, 'pearson_r', correlation) as (metric, score)"))
    base = long.filter(F.col(mode) == reference).select("draw", "metric", F.col("score").alias("_base"))
    diff = long.join(base, ["draw", "metric"]).withColumn("change", F.col("score") - F.col("_base"))
    point = diff.filter("draw = 0").select(mode, "metric", "score")
    return interval_of(diff, [mode, "metric"], "change").withColumnRenamed("value", "change").join(point, [mode, "metric"])


def station_skill(df: DataFrame, mode: str, draws: int, seed: int, reference: str | None = None, by: list[str] = ()) -> DataFrame:
    """Between-station and within-station correlation and macro RMSE per mode, and their change against ``reference`` if given, with site-clustered bounds.

    Sensors of one station and date are averaged first. Rows: ``by`` (such as the task), site, station, date, pred, target. All modes
    of a draw resample the same sites. ``stations`` and ``windows`` count what the estimates rest on.
    """
    by = list(by)
    windows = df.groupBy(*by, "site", "station", "date", mode).agg(F.avg("pred").alias("x"), F.avg("target").alias("y"))
    n = F.count(F.lit(1))
    st = windows.groupBy(*by, "site", "station", mode).agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg((F.col("x") - F.col("y")) ** 2).alias("mse"),
        (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"), (F.covar_pop("x", "y") * n).alias("sxy"))
    many = lambda c: F.sum(F.when(F.col("n") >= 2, F.col(c)).otherwise(0.0))
    cols = {"stations": n, "windows": F.sum("n"), "bx": F.sum("mx"), "by": F.sum("my"), "bxx": F.sum(F.col("mx") ** 2), "byy": F.sum(F.col("my") ** 2),
            "bxy": F.sum(F.col("mx") * F.col("my")), "wxx": many("sxx"), "wyy": many("syy"), "wxy": many("sxy"), "err": F.sum(F.sqrt("mse"))}
    site = st.groupBy(*by, "site", mode).agg(*[c.alias(k) for k, c in cols.items()])
    total = bootstrap_sums(site, group_draws(df, "site", draws, seed), "site", [*by, mode], list(cols))
    k = F.col("stations")
    bvx, bvy = F.col("bxx") - F.col("bx") ** 2 / k, F.col("byy") - F.col("by") ** 2 / k
    between = F.when((bvx > 1e-12) & (bvy > 1e-12), (F.col("bxy") - F.col("bx") * F.col("by") / k) / F.sqrt(bvx * bvy))
    within = F.when((F.col("wxx") > 0) & (F.col("wyy") > 0), F.col("wxy") / F.sqrt(F.col("wxx") * F.col("wyy")))
    long = total.select("draw", *by, mode, "stations", "windows", between.alias("b"), within.alias("w"), (F.col("err") / k).alias("m")).select(
        "draw", *by, mode, "stations", "windows", F.expr("stack(3, 'between_r', b, 'within_r', w, 'macro_rmse', m) as (metric, score)"))
    keys = [*by, mode, "metric"]
    counts = long.filter("draw = 0").select(*keys, "stations", "windows")
    if reference is None:
        return interval_of(long, keys, "score").join(counts, keys)
    base = long.filter(F.col(mode) == reference).select("draw", *by, "metric", F.col("score").alias("_base"))
    diff = long.join(base, ["draw", *by, "metric"], "left").withColumn("change", F.col("score") - F.col("_base"))
    change = interval_of(diff, keys, "change").toDF(*keys, "change", "change_low", "change_high")
    return interval_of(diff, keys, "score").join(change, keys).join(counts, keys)


def best_epoch(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Highest finite score of each run; the first epoch on ties."""
    s = F.col(score)
    ok = df.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    return ok.groupBy(run).agg(F.max(F.struct(s, (-F.col(epoch)).alias("_e"))).alias("_b")).select(
        run, (-F.col("_b._e")).alias(epoch), F.col(f"_b.{score}").alias(score))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable count, mean and M2 with the population standard deviation; refused when degenerate."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
    return with_std(out)


def with_std(df: DataFrame) -> DataFrame:
    std = F.sqrt(F.try_divide(F.col("m2"), F.col("n")))
    reason = F.when(F.col("n") < 2, "too_few").when(std <= 1e-8, "degenerate")
    return df.withColumn("std", F.when(reason.isNull(), std)).withColumn("reason", reason)


def merge_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Combine partial moments: pooled within plus between sums of squares."""
    n, m = F.col("n"), F.col("mean")
    out = df.filter("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(n * m) / F.sum(n)).alias("mean"),
                                               F.sum("m2").alias("_m2"), F.sum(n * m * m).alias("_nm2"))
    return with_std(out.select(*keys, "n", "mean", F.greatest(F.lit(0.0), F.col("_m2") + F.col("_nm2") - F.col("n") * F.col("mean") ** 2).alias("m2")))


def moments_from_sums(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    mean = total / n
    return mean, F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))


def scaled_score(df: DataFrame, keys: list[str], task: str, scales: dict[str, float]) -> DataFrame:
    """Minus the mean RMSE in units of the train standard deviation."""
    scale = F.create_map(*[F.lit(x) for kv in scales.items() for x in kv])
    return df.groupBy(*keys).agg((-F.avg(F.col("rmse") / scale[F.col(task)])).alias("score"))


def joint_score(scores: DataFrame, source: str, product: str, site: str, weight: float = 2.0 / 3.0) -> DataFrame:
    of = lambda name: F.max(F.when(F.col(source) == name, F.col("score")))
    out = scores.agg(of(product).alias("product_score"), of(site).alias("site_score"))
    return out.withColumn("joint_score", F.col("product_score") * (1 - weight) + F.col("site_score") * weight)


def point_summary(df: DataFrame, cell: list[str], truth: str, predicted: str, order: str, site: str) -> DataFrame:
    """Counts of points, conflicts and unique consistent cells, one row per item."""
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    conflict = conflicting_cells(df.filter("label_valid"), cell, truth)
    scored = df.filter("label_valid and prediction_valid and not training_overlap")
    unique = scored.join(conflict, cell, "left_anti").groupBy(*cell).agg(F.min_by(F.struct(truth, predicted), order).alias("_u"))
    parts = [one(df, "total"), one(scored, "scored"), one(df.filter("label_valid and not prediction_valid"), "invalid_prediction"),
             one(df.filter("training_overlap"), "training_overlap"), one(conflict, "conflicting_cells"), one(unique, "unique_cells"),
             one(unique.filter(F.col(f"_u.{truth}") == F.col(f"_u.{predicted}")), "unique_correct"),
             scored.groupBy(F.concat(F.lit("site:"), F.col(site)).alias("item")).agg(F.count(F.lit(1)).alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predictions_at_points(points: DataFrame, pixels: DataFrame, keys: list[str], classes: list[str], tolerance: float = 0.01) -> DataFrame:
    """Left join of points to predicted fractions; fractions must sum to one, ties take the first class."""
    out = points.join(pixels, keys, "left")
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    p = F.array(*[F.col(c) for c in classes])
    winner = F.when(F.col(classes[0]).isNotNull(), F.array_position(p, F.array_max(p)) - 1).cast("int")
    ok = F.coalesce(total.between(1 - tolerance, 1 + tolerance), F.lit(False))
    return out.drop("prediction_valid").withColumn("prediction_valid", ok).withColumn("predicted", winner)


def paired_arms(df: DataFrame, block: str, arm: str, pred: str, target: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """RMSE of ``b`` minus ``a`` on the same resampled blocks, bounds, and relative improvement."""
    sums = regression_sums(df, [block, arm], pred, target)
    total = bootstrap_sums(sums, group_draws(df, block, draws, seed), block, [arm], ["count", "sum_sq"])
    rmse = F.sqrt(F.col("sum_sq") / F.col("count"))
    of = lambda name: F.max(F.when(F.col(arm) == name, rmse))
    d = total.groupBy("draw").agg(of(a).alias("_a"), of(b).alias("_b")).withColumn("difference", F.col("_b") - F.col("_a"))
    base = d.filter("draw = 0").select(((F.col("_a") - F.col("_b")) / F.col("_a")).alias("relative_improvement"))
    out = interval_of(d, [], "difference").withColumnRenamed("value", "difference")
    return out.withColumn("relative_improvement", base.scalar())


def seed_block_bootstrap(df: DataFrame, seed_col: str, block: str, arm: str, pred: str, target: str, draws: int, seed: int) -> DataFrame:
    """Mean RMSE over seeds with seeds and blocks resampled jointly; sums per (seed, block) come first."""
    sums = regression_sums(df, [seed_col, block, arm], pred, target).select(seed_col, block, arm, "count", "sum_sq")
    seeds = group_draws(df, seed_col, draws, seed).withColumnRenamed("weight", "_ws")
    blocks = group_draws(df, block, draws, seed + 1).withColumnRenamed("weight", "_wb")
    j = sums.join(seeds, seed_col).join(blocks, [block, "draw"])
    per = j.groupBy("draw", arm, seed_col).agg(F.max("_ws").alias("_ws"), F.sum(F.col("count") * F.col("_wb")).alias("_n"), F.sum(F.col("sum_sq") * F.col("_wb")).alias("_e"))
    mean = per.groupBy("draw", arm).agg((F.sum(F.sqrt(F.col("_e") / F.col("_n")) * F.col("_ws")) / F.sum("_ws")).alias("score"))
    return interval_of(mean, [arm], "score")


def parse_epochs(lines: DataFrame, line: str) -> DataFrame:
    """Complete JSON lines of a run log; a broken line is skipped."""
    return lines.select(F.from_json(line, "run bigint, epoch bigint, score double, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).filter("e._bad is null").select("e.run", "e.epoch", "e.score")
