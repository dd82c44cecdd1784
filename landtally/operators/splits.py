"""Leakage-safe splits over whole spatial groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landtally.functions import keys as K
from landtally.operators import spatial
from landtally.operators.ordered import numbered_by_hash, running_before
from landtally.session import cut_lineage

TASKS = ("sm", "et")


def assign_splits(stations: DataFrame, products: DataFrame, seed: int = 43, development: Column | None = None,
                  colocated_m: float = 30.0) -> DataFrame:
    """Group stations whose supports meet, then draw one split per group.

    ``stations``: location_id, group_id, lon, lat. ``products``: product_id, lon, lat, radius_m.
    Physical groups share an identity or lie within ``colocated_m``; spatial groups also join when
    station tiles meet. A group that meets a product support, or holds a development site, is train.
    """
    # Stations and their links feed two component jobs: written once, read often.
    located = cut_lineage(stations.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()))
    identity = spatial.identity_links(located, "location_id", "group_id")
    near = cut_lineage(identity.unionByName(spatial.distance_links(located, "location_id", colocated_m)))
    # Tiles meet when places are at most the sum of both radii apart; equal places are linked above.
    places = located.groupBy("lon", "lat").agg(F.min("location_id").alias("a"))
    place_circles = cut_lineage(spatial.tile_circle(places))
    tiles = spatial.circles_overlap(place_circles, place_circles.withColumnRenamed("a", "b"), cell_m=2000.0,
                                    left_id="a", right_id="b").filter("a < b").select("a", "b")
    nodes = located.select("location_id")
    physical = spatial.components(nodes, near, "location_id", "_physical")
    grouped = spatial.components(nodes, near.unionByName(tiles), "location_id", "spatial_group_id")
    names = located.join(physical, "location_id")
    physical_name = names.groupBy("_physical").agg(F.min("group_id").alias("physical_group_id"))
    supports = _supports(products)
    counts = _support_counts(_supports_met(place_circles, supports, "a"), supports, "a")
    touched = places.join(counts, "a").select("lon", "lat", "product_overlap_count")
    out = names.join(touched, ["lon", "lat"], "left").join(physical_name, "_physical").drop("_physical").join(grouped, "location_id")
    out = out.withColumn("product_overlap_count", F.coalesce("product_overlap_count", F.lit(0))).select(
        "location_id", *[c for c in located.columns if c != "location_id"], "physical_group_id", "spatial_group_id", "product_overlap_count")
    dev = F.lit(False) if development is None else development
    out = cut_lineage(out)
    flags = out.groupBy("spatial_group_id").agg(
        F.max("product_overlap_count").alias("_hit"), F.max(dev.cast("int")).alias("_dev"))
    draw = K.split_of_percent(K.hash_percent(K.fingerprint(seed, K.quoted(F.col("spatial_group_id")))))
    reason = (F.when(F.col("_dev") == 1, "previous_development_group")
              .when(F.col("_hit") > 0, "product_overlap_requires_train").otherwise("seeded_group_assignment"))
    flags = flags.select("spatial_group_id", reason.alias("split_reason"),
                         F.when(reason == "seeded_group_assignment", draw).otherwise("train").alias("split"))
    out = cut_lineage(out.join(flags, "spatial_group_id"))
    lost = stations.filter(F.col("lon").isNull() | F.col("lat").isNull()).withColumn("split", F.lit("unresolved"))
    return out.unionByName(lost, allowMissingColumns=True)


def _supports(products: DataFrame) -> DataFrame:
    """(product_id, support): many products have one circle, which is measured once."""
    return cut_lineage(products.select("product_id", F.struct("lon", "lat", "radius_m").alias("support")).distinct())


def _supports_met(circles: DataFrame, supports: DataFrame, key: str) -> DataFrame:
    """(key, support) where circles meet; pairs of places and circles, whatever the number of stations and products on them."""
    each = supports.select("support").distinct().select("support", "support.*")
    return cut_lineage(spatial.circles_overlap(circles, each, left_id=key, right_id="support").select(key, "support"))


def _support_counts(met: DataFrame, supports: DataFrame, key: str) -> DataFrame:
    """Distinct products per key: those with one circle are summed by circle, only those with several are told apart by id."""
    spans = supports.groupBy("product_id").agg(F.min("support").alias("_lo"), F.max("support").alias("_hi"))
    single = spans.filter("_lo = _hi").groupBy(F.col("_lo").alias("support")).agg(F.count("product_id").alias("_n"))
    several = supports.join(spans.filter("_lo <> _hi").select("product_id"), "product_id")
    counts = met.join(single, "support").select(key, "_n").unionByName(
        met.join(several, "support").groupBy(key).agg(F.countDistinct("product_id").alias("_n")))
    return counts.groupBy(key).agg(F.sum("_n").alias("product_overlap_count"))


def product_hits(stations: DataFrame, products: DataFrame) -> DataFrame:
    """Products (``product_id``) that meet the tile of any station; ``stations``: lon, lat."""
    places = stations.select("lon", "lat").distinct().withColumn("place", F.struct("lon", "lat"))
    supports = _supports(products)
    met = _supports_met(cut_lineage(spatial.tile_circle(places)), supports, "place")
    return supports.join(met.select("support").distinct(), "support").select("product_id").distinct()


def product_selection(products: DataFrame, hits: DataFrame) -> DataFrame:
    """Drop evaluation products that meet a train station support."""
    leaked = hits.filter("site_split = 'train'").select("product_id").distinct()
    train, rest = products.filter("split = 'train'"), products.filter("split <> 'train'")
    return train.unionByName(rest.join(leaked, "product_id", "left_anti"))


def task_coverage(df: DataFrame, locked: DataFrame, group: str = "spatial_group_id", tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Independent groups per bin and task, and the minimum each split must keep."""
    entries = [F.struct(F.lit(t).alias("task"), (F.col(f"valid_{t}") > 0).alias("has")) for t in tasks]
    long = df.select("frequency_bin", group, F.inline(F.array(*entries))).filter("has").select("frequency_bin", "task", group).distinct()
    long = long.join(locked.select(group).distinct().withColumn("_locked", F.lit(1)), group, "left")
    counts = long.groupBy("frequency_bin", "task").agg(
        F.count(F.lit(1)).alias("spatial_groups"), F.sum(F.when(F.col("_locked").isNull(), 1).otherwise(0)).alias("free_groups"))
    feasible = (F.col("spatial_groups") >= 3) & (F.col("free_groups") >= 2)
    half = lambda c: F.floor(c / 2).cast("bigint")
    need = F.when(feasible, F.least(F.lit(2), half(F.col("spatial_groups") - 1), half(F.col("free_groups")))).otherwise(0)
    return counts.withColumn("feasible", feasible).withColumn("minimum_evaluation", need.cast("bigint")).withColumn(
        "minimum_train", F.when(F.col("spatial_groups") > 0, 1).otherwise(0))


def stratify_groups(df: DataFrame, locked: DataFrame, seed: int = 43, group: str = "spatial_group_id") -> DataFrame:
    """Whole groups to train, validation and test: task minimums first, then a cumulative share of windows.

    Work is on one row per group. A group belongs to its rarest bin; a locked group is train.
    """
    sizes = df.groupBy(group, "frequency_bin").agg(
        F.count(F.lit(1)).alias("_w"), *[F.sum((F.col(f"valid_{t}") > 0).cast("int")).alias(f"_{t}") for t in TASKS])
    bins = sizes.groupBy("frequency_bin").agg(F.sum("_w").alias("_bin"))
    rarest = sizes.join(F.broadcast(bins), "frequency_bin").groupBy(group).agg(
        F.min(F.struct("_bin", "frequency_bin")).alias("_r"), F.sum("_w").alias("windows"),
        *[F.max(F.when(F.col(f"_{t}") > 0, 1).otherwise(0)).alias(f"_{t}") for t in TASKS])
    base = rarest.select(group, F.col("_r.frequency_bin").alias("frequency_bin"), "windows", *[f"_{t}" for t in TASKS])
    base = base.join(locked.select(group).distinct().withColumn("_locked", F.lit(True)), group, "left")
    base = cut_lineage(base.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(group)))))
    need = task_coverage(df, locked, group)
    # Reserve evaluation groups per bin and task from the unlocked groups that carry it in that bin.
    entries = [F.struct(F.lit(t).alias("task"), (F.col(f"_{t}") > 0).alias("has")) for t in TASKS]
    free = sizes.join(base.filter("_locked is null").select(group, "_hash"), group).select(
        group, "frequency_bin", "_hash", F.inline(F.array(*entries))).filter("has")
    ranked = numbered_by_hash(free, ["frequency_bin", "task"], "_hash", "_rank").join(
        F.broadcast(need.select("frequency_bin", "task", "minimum_evaluation")), ["frequency_bin", "task"])
    m = F.col("minimum_evaluation")
    reserved = ranked.filter(F.col("_rank") <= m * 2).withColumn("_rank_split", F.when(F.col("_rank") <= m, 1).otherwise(2))
    reserved = reserved.groupBy(group).agg(F.min(F.struct("_rank", "_rank_split")).alias("_s")).select(group, F.col("_s._rank_split").alias("_forced"))
    rows = base.join(reserved, group, "left").withColumn(
        "_stage", F.when(F.col("_locked"), 0).when(F.col("_forced").isNotNull(), 1).otherwise(2))
    total = rows.groupBy("frequency_bin").agg(
        F.sum("windows").alias("_total"), F.sum(F.when(F.col("_forced") == 1, F.col("windows")).otherwise(0)).alias("_v"),
        F.sum(F.when(F.col("_forced") == 2, F.col("windows")).otherwise(0)).alias("_t"))
    rows = running_before(rows, ["frequency_bin", "_stage"], [F.col("_hash")], "windows", "_before", K.hash_bucket(F.col("_hash")))
    rows = rows.join(F.broadcast(total), "frequency_bin").withColumn("_cum", F.col("_before") + F.col("windows"))
    room_v = F.greatest(F.lit(0.0), F.col("_total") * 0.15 - F.col("_v"))
    room_t = F.greatest(F.lit(0.0), F.col("_total") * 0.15 - F.col("_t"))
    split = (F.when(F.col("_stage") == 0, "train").when(F.col("_forced") == 1, "validation").when(F.col("_forced") == 2, "test")
             .when(F.col("_cum") <= room_v, "validation").when(F.col("_cum") <= room_v + room_t, "test").otherwise("train"))
    return rows.select(group, "windows", split.alias("split"))


def rebalance_et(df: DataFrame, seed: int = 43, share: float = 0.15, group: str = "spatial_group_id") -> DataFrame:
    """Keep evaluation groups up to ``share`` of each bin's ET windows and move the rest to train.

    Train is never exposed. Groups with soil-moisture labels or several bins stay where they are.
    The retained set is the hash-ordered prefix whose windows come closest to the target.
    """
    et = df.filter("valid_et > 0")
    facts = df.groupBy(group).agg(F.first("split").alias("_split"), F.max("valid_sm").alias("_sm"))
    per = et.groupBy(group, "frequency_bin").agg(F.count(F.lit(1)).alias("_w"))
    mixed = per.groupBy(group).agg(F.count(F.lit(1)).alias("_bins"))
    total = per.groupBy("frequency_bin").agg((F.sum("_w") * share).alias("_goal"))
    rows = per.join(facts, group).join(mixed, group).filter("_split <> 'train'")
    rows = rows.withColumn("_fixed", (F.col("_sm") > 0) | (F.col("_bins") > 1)).withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(group))))
    rows = cut_lineage(rows)
    cell = ["frequency_bin", "_split"]
    bucket = F.when(F.col("_fixed"), 0).otherwise(65536) + K.hash_bucket(F.col("_hash"))
    order = [F.col("_fixed").desc(), F.col("_hash")]
    rows = running_before(rows.withColumn("_one", F.lit(1)), cell, order, "_w", "_w_before", bucket)
    rows = cut_lineage(running_before(rows, cell, order, "_one", "_n_before", bucket))
    fixed = rows.groupBy(*cell).agg(F.sum(F.col("_fixed").cast("int")).alias("_nfixed"))
    rows = rows.join(fixed, cell).join(F.broadcast(total), "frequency_bin").withColumn("_n", F.col("_n_before") + 1)
    gap = F.abs(F.col("_w_before") + F.col("_w") - F.col("_goal"))
    whole = F.col("_n") >= F.greatest(F.col("_nfixed"), F.lit(1))
    best = rows.groupBy(*cell).agg(F.min(F.when(whole, F.struct(gap.alias("gap"), F.col("_n").alias("n")))).alias("_b"))
    rows = rows.join(best, cell)
    keep = rows.groupBy(group).agg(F.max(((F.col("_n") <= F.col("_b.n")) | F.col("_fixed")).cast("int")).alias("_keep"))
    out = facts.join(keep, group, "left").select(
        group, F.col("_split").alias("previous_split"),
        F.when(F.col("_keep") == 0, "train").otherwise(F.col("_split")).alias("split"))
    return out


def heldout_groups(df: DataFrame, cohort: str, share: float = 0.1, spatial_col: str = "spatial_group_id",
                   physical: str = "physical_group_id") -> DataFrame:
    """Whole connected groups held out of every cohort, at least one other group staying in each.

    Components come from the bipartite links of spatial and physical ids. Groups are taken in hash
    order per cohort until ``share`` of its rows is covered; the guard walks the few cohorts.
    """
    pairs = df.select(spatial_col, physical).distinct()
    edges = pairs.select(F.concat(F.lit("s"), spatial_col).alias("a"), F.concat(F.lit("p"), physical).alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    comp = spatial.components(nodes, edges, "node", "group")
    named = comp.filter("node like 's%'").select(F.substring("node", 2, 1 << 20).alias(spatial_col), "group")
    sizes = df.withColumn(spatial_col, F.col(spatial_col).cast("string")).join(named, spatial_col).groupBy(cohort, "group").agg(F.count(F.lit(1)).alias("rows"))
    sizes = cut_lineage(sizes.withColumn("_hash", F.sha2(F.col("group"), 256)))
    # The last group of each cohort in hash order always stays, so no cohort is emptied.
    spared = sizes.groupBy(cohort).agg(F.max_by("group", "_hash").alias("group")).select("group").distinct()
    free = sizes.join(spared, "group", "left_anti")
    goals = sizes.groupBy(cohort).agg(F.greatest(F.lit(1), F.bround(F.sum("rows") * share)).alias("_goal"))
    chosen = free.select("group").limit(0)
    # A handful of cohorts, taken in order because earlier picks count towards later ones.
    for name in [r[0] for r in goals.select(cohort).orderBy(cohort).collect()]:
        mine = free.filter(F.col(cohort) == name)
        have = mine.join(chosen, "group", "left_semi").groupBy(cohort).agg(F.sum("rows").alias("_have"))
        rest = running_before(mine.join(chosen, "group", "left_anti"), [cohort], [F.col("_hash")], "rows", "_before",
                              K.hash_bucket(F.col("_hash")))
        rest = rest.join(F.broadcast(goals), cohort).join(F.broadcast(have), cohort, "left")
        more = rest.filter(F.coalesce("_have", F.lit(0)) + F.col("_before") < F.col("_goal")).select("group")
        chosen = cut_lineage(chosen.unionByName(more).distinct())
    return sizes.join(chosen.withColumn("heldout", F.lit(True)), "group", "left").select(
        cohort, "group", "rows", F.coalesce("heldout", F.lit(False)).alias("heldout"))
