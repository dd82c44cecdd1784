"""Plans composed from draws and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landtally.functions import keys as K
from landtally.operators import draws, sets, spatial, splits
from landtally.operators.ordered import numbered_by_hash


def planned_draw(pool: DataFrame, bin_: str, period: str, climate: str, total: int, seed: int,
                 key: str = "sample_id", bins: int = 7) -> tuple[DataFrame, DataFrame]:
    """Bin quotas, shared over periods, shared over climates, filled in hash priority.

    Returns the drawn rows and the quota table with ``taken`` and ``deficit``. Spacing rules run
    before or after with ``draws.conflict_free``.
    """
    cells = pool.groupBy(bin_, period, climate).agg(F.count(F.lit(1)).alias("pool"))
    periods = cells.select(bin_, period).distinct()
    w = Window.partitionBy(bin_)
    order = F.row_number().over(w.orderBy(period))
    n = F.count(F.lit(1)).over(w)
    # The pool's bins are few, and so are the periods of a bin: these tables stay small.
    # The first bins take one more each where the total does not divide.
    place = F.row_number().over(Window.orderBy(bin_))
    shares = cells.select(bin_).distinct().withColumn("_share", F.lit(total // bins) + F.when(place <= total % bins, 1).otherwise(0))
    periods, share = periods.join(shares, bin_), F.col("_share")
    periods = periods.withColumn("_t", (F.floor(share / n) + F.when(order <= share % n, 1).otherwise(0)).cast("bigint")).drop("_share")
    cells = cells.join(periods, [bin_, period])
    w2 = Window.partitionBy(bin_, period)
    weight = F.lit(0.5) / F.count(F.lit(1)).over(w2) + F.lit(0.5) * F.col("pool") / F.sum("pool").over(w2)
    cells = draws.largest_remainder(cells.withColumn("_e", F.col("_t") * weight), [bin_, period], F.col("_e"), F.col("_t"), [F.col("pool").desc(), F.col(climate)])
    quotas = cells.select(bin_, period, climate, "pool", "quota", F.least("quota", "pool").alias("taken"), F.greatest(F.lit(0), F.col("quota") - F.col("pool")).alias("deficit"))
    ranked = numbered_by_hash(pool.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key)))), [bin_, period, climate], "_hash", "_rank")
    rows = ranked.join(quotas.select(bin_, period, climate, "quota"), [bin_, period, climate]).filter(F.col("_rank") <= F.col("quota"))
    return rows.drop("_hash", "_rank", "quota"), quotas


def resplit(df: DataFrame, locked: DataFrame, seed: int, group: str = "spatial_group_id") -> tuple[DataFrame, DataFrame]:
    """Apply new group splits to every cohort; also the distribution by bin and split."""
    plan = splits.stratify_groups(df, locked, seed, group).select(group, F.col("split").alias("_new"))
    rows = df.withColumnRenamed("split", "original_split").join(plan, group).withColumnRenamed("_new", "split")
    report = rows.groupBy("frequency_bin", "split").agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("physical_group_id").alias("physical_sites"), F.countDistinct(group).alias("spatial_groups"),
        F.sum((F.col("valid_sm") > 0).cast("int")).alias("sm_windows"), F.sum((F.col("valid_et") > 0).cast("int")).alias("et_windows"),
        F.sum((F.col("split") != F.col("original_split")).cast("int")).alias("changed_windows"))
    return rows, report


def training_overlap(windows: DataFrame, training: DataFrame, margin_m: float, window_id: str, train_id: str) -> DataFrame:
    """Windows whose circle plus margin meets any training circle; the nearest one is reported."""
    wide = windows.withColumn("radius_m", F.col("radius_m") + margin_m)
    hits = spatial.circles_overlap(wide, training, left_id=window_id, right_id=train_id)
    near = hits.groupBy(window_id).agg(F.min(F.struct("distance_m", train_id)).alias("_b"), F.count(F.lit(1)).alias("training_hits"))
    return windows.select(window_id).join(near, window_id, "left").select(
        window_id, F.col("_b").isNotNull().alias("training_overlap"), F.coalesce("training_hits", F.lit(0)).alias("training_hits"), F.col(f"_b.{train_id}").alias("nearest_id"))


def supplement(df: DataFrame, accepted: Column, relaxed: Column, date_key: list[str]) -> DataFrame:
    """Rejected rows that pass relaxed thresholds, and the other rejected rows of dates not yet used."""
    used = df.filter(accepted).select(*date_key).distinct()
    rejected = df.filter(~accepted)
    recovered = rejected.filter(relaxed).withColumn("origin", F.lit("recovered"))
    unused = rejected.filter(~relaxed).join(used, date_key, "left_anti").withColumn("origin", F.lit("unused_date"))
    return recovered.unionByName(unused)


def revision(published: DataFrame, passing: DataFrame, pool: DataFrame, added: int, seed: int) -> DataFrame:
    """Drop failing ET stations, rebalance evaluation groups, and plan an additive pool.

    One row per split: rows kept, target, deficit and pool candidates not already present.
    """
    date_key = ["physical_group_id", "target_time", "target_end"]
    keep = published.filter("valid_et = 0").unionByName(published.filter("valid_et > 0").join(passing, "physical_group_id", "left_semi"))
    plan = splits.rebalance_et(keep, seed).select("spatial_group_id", F.col("split").alias("_new"))
    revised = keep.join(plan, "spatial_group_id").withColumn("split", F.col("_new")).drop("_new")
    deficits = draws.split_deficits(revised.filter("valid_et > 0"), "split", added)
    fresh = pool.filter("valid_et > 0").join(passing, "physical_group_id", "left_semi").join(published.select(*date_key).distinct(), date_key, "left_anti")
    fresh = sets.preferred(fresh.drop("split"), date_key, [~F.col("operator_ready"), F.col("source_priority"), F.col("candidate_id")])
    have = fresh.join(plan, "spatial_group_id").groupBy(F.col("_new").alias("split")).agg(F.count(F.lit(1)).alias("pool"))
    return deficits.join(have, "split", "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
