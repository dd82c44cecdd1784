"""Quotas, capacity-balanced draws, spaced schedules and reproducible samples.

Draws work top-down on counted strata: quotas are settled on aggregated tables and the candidate
table is touched twice, once to count and once to take the first rows of each leaf in hash order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from landtally.functions import keys as K
from landtally.operators.ordered import first_by_hash, numbered, numbered_by_hash, numbered_overall, running_before, same_keys, visit_bucket
from landtally.session import cut_lineage, spread, written

STRATA = ["landcover", "climate_class", "year", "month"]


def even_quotas(groups: DataFrame, key: str, total: int) -> DataFrame:
    """``total`` shared over the distinct keys; the first ``total % n`` keys take one more."""
    whole = groups.select(key).distinct().select(
        key, F.row_number().over(Window.partitionBy().orderBy(key)).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    t = F.lit(total)
    share = F.floor(t / F.col("_n")) + F.when(F.col("_i") <= t % F.col("_n"), 1).otherwise(0)
    return whole.select(key, share.cast("bigint").alias("quota"))


def largest_remainder(df: DataFrame, groups: list[str], exact: Column, total: Column,
                      tie: list[Column]) -> DataFrame:
    """Floors of ``exact`` topped up to ``total`` by falling remainder. ``df`` is a table of strata."""
    out = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    w = Window.partitionBy(*groups)
    rank = F.row_number().over(w.orderBy((F.col("_exact") - F.col("_floor")).desc(), *tie))
    left = total - F.sum("_floor").over(w)
    quota = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return out.withColumn("_rank", rank).withColumn("_left", left).withColumn(
        "quota", quota.cast("bigint")).drop("_exact", "_floor", "_rank", "_left")


def climate_quotas(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Half equal, half proportional; ties of the remainder go to the larger count."""
    w = Window.partitionBy()
    weight = F.lit(0.5) / F.count(F.lit(1)).over(w) + F.lit(0.5) * F.col(count) / F.sum(count).over(w)
    base = counts.withColumn("_w", weight)
    return largest_remainder(base, [], F.col("_w") * total, F.lit(total),
                             [F.col(count).desc(), F.col(key)]).drop("_w")


def maxmin_allocate(children: DataFrame, parents: list[str], capacity: str, total: str, order: str) -> DataFrame:
    """Integer max-min shares of each parent's ``total``: scarce children are exhausted, the rest equalised.

    The common level comes from the histogram of capacities, so a parent may have any number of
    children. The remainder goes, one each, to the first unsaturated children by ``order`` (a hash).
    """
    hist = children.groupBy(*parents, capacity).agg(
        F.count(F.lit(1)).alias("_n"), F.max(total).alias("_asked"))
    w = Window.partitionBy(*parents)
    below = w.orderBy(capacity).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(
        "*", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_kids_below"),
        F.coalesce(F.sum(F.col("_n") * F.col(capacity)).over(below), F.lit(0)).alias("_sum_below"),
        F.sum("_n").over(w).alias("_kids"), F.sum(F.col("_n") * F.col(capacity)).over(w).alias("_all"))
    hist = hist.withColumn("_take", F.least("_asked", "_all"))
    level = F.floor((F.col("_take") - F.col("_sum_below")) / (F.col("_kids") - F.col("_kids_below")))
    spent = F.col("_sum_below") + level * (F.col("_kids") - F.col("_kids_below"))
    # The first capacity above its own level fixes the level; none means every child is exhausted.
    found = F.when(level < F.col(capacity), F.struct(F.col(capacity), level.alias("low"), spent.alias("spent")))
    levels = hist.withColumn("_found", found).groupBy(*parents).agg(
        F.min("_found").alias("_f"), F.max(capacity).alias("_top"), F.max("_take").alias("_take"), F.max("_all").alias("_all"))
    levels = levels.select(*parents, F.coalesce("_f.low", "_top").alias("_low"),
                           (F.col("_take") - F.coalesce("_f.spent", "_all")).alias("_left"))
    if parents:
        joined = children.alias("c").join(levels.alias("v"), same_keys("c", "v", parents))
        joined = joined.select(*[F.col(f"c.{c}") for c in children.columns], "v._low", "v._left")
    else:
        joined = children.withColumn("_low", levels.select("_low").scalar()).withColumn("_left", levels.select("_left").scalar())
    joined = joined.withColumn("_open", F.when(F.col(capacity) > F.col("_low"), 1).otherwise(0))
    ranked = numbered_by_hash(joined, [*parents, "_open"], order, "_rank")
    extra = F.when((F.col("_open") == 1) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    quota = F.least(F.col(capacity), F.col("_low")) + extra
    return ranked.withColumn("quota", quota.cast("bigint")).drop("_low", "_left", "_open", "_rank")


def maxmin_top_up(children: DataFrame, parents: list[str], have: str, capacity: str, total: str, order: str) -> DataFrame:
    """Integer shares of each parent's ``total`` that level the children up: the least filled first, none above what it can hold.

    A child takes from its ``have`` up to ``have + capacity``. How many children still take at a level changes only where one
    begins or ends, so the level comes from the table of those points; the remainder goes, one each, to the first by ``order``.
    """
    points = children.filter(F.col(capacity) > 0).select(*parents, F.col(total).alias("_asked"), F.inline(F.array(
        F.struct(F.col(have).cast("bigint").alias("_at"), F.lit(1).alias("_turn")), F.struct((F.col(have) + F.col(capacity)).cast("bigint").alias("_at"), F.lit(-1).alias("_turn")))))
    points = points.groupBy(*parents, "_at").agg(F.sum("_turn").alias("_turn"), F.max("_asked").alias("_asked"))
    along = Window.partitionBy(*parents).orderBy("_at")
    points = points.withColumn("_takers", F.sum("_turn").over(along)).withColumn("_next", F.lead("_at").over(along))
    points = points.withColumn("_room", F.coalesce((F.col("_next") - F.col("_at")) * F.col("_takers"), F.lit(0)))
    points = points.withColumn("_spent", F.sum("_room").over(along) - F.col("_room"))
    left = F.col("_asked") - F.col("_spent")
    rise = F.floor(left / F.col("_takers"))
    # The segment in which the total ends; a total beyond all room ends at the last point.
    ends = (F.col("_takers") > 0) & (left < F.col("_room")) & (left >= 0)
    found = F.when(ends, F.struct((F.col("_at") + rise).alias("low"), (left - rise * F.col("_takers")).alias("rest")))
    levels = points.groupBy(*parents).agg(F.min(found).alias("_f"), F.max("_at").alias("_top"))
    levels = levels.select(*parents, F.coalesce("_f.low", "_top").alias("_low"), F.coalesce("_f.rest", F.lit(0)).alias("_left"))
    joined = children.alias("c").join(levels.alias("v"), same_keys("c", "v", parents), "left").select(*[F.col(f"c.{c}") for c in children.columns], "v._low", "v._left")
    room = F.greatest(F.lit(0), F.least(F.col("_low") - F.col(have), F.col(capacity)))
    joined = joined.withColumn("_open", F.when((F.col(have) <= F.col("_low")) & (F.col("_low") < F.col(have) + F.col(capacity)), 1).otherwise(0))
    ranked = numbered_by_hash(joined, [*parents, "_open"], order, "_rank")
    extra = F.when((F.col("_open") == 1) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    return ranked.withColumn("quota", F.coalesce(room + extra, F.lit(0)).cast("bigint")).drop("_low", "_left", "_open", "_rank")


def stratum_quotas(counts: DataFrame, top: str, levels: list[str], seed: int) -> DataFrame:
    """Push the quota of each ``top`` group down ``levels``; ``counts`` has ``n`` and ``top_quota``."""
    path = [top]
    # Each level reads the one above twice: the counted table (strata, not rows) is written between levels.
    current = cut_lineage(counts.withColumn("_asked", F.col("top_quota")))
    for level in levels:
        nodes = current.groupBy(*path, level).agg(F.sum("n").alias("_capacity"), F.max("_asked").alias("_total"))
        nodes = nodes.withColumn("_hash", K.hash_rank(seed, K.canonical_list(*[F.col(c) for c in [*path, level]])))
        shares = maxmin_allocate(nodes, path, "_capacity", "_total", "_hash")
        path = [*path, level]
        share = shares.select(*path, F.col("quota").alias("_share"))
        current = cut_lineage(current.drop("_asked").join(share, path).withColumnRenamed("_share", "_asked"))
    return current


def frequency_quotas(counts: DataFrame, top: str, total: int) -> DataFrame:
    """Nonzero bins share ``total`` by max-min in bin order; bin 0 takes what is left over."""
    sizes = counts.groupBy(top).agg(F.sum("n").alias("_capacity")).withColumn("_total", F.lit(total).cast("bigint"))
    # Few bins: their order as a fixed-width hex string ranks like a hash.
    nonzero = sizes.filter(F.col(top) != 0).withColumn("_hash", F.lpad(F.hex(F.col(top).cast("bigint")), 8, "0"))
    shared = maxmin_allocate(nonzero, [], "_capacity", "_total", "_hash").select(top, "quota")
    used = shared.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("_used"))
    zero = sizes.filter(F.col(top) == 0).select(top, F.least(F.col("_capacity"), F.lit(total) - used.scalar()).alias("quota"))
    return shared.unionByName(zero)


def balanced_draw(candidates: DataFrame, seed: int, total: int, top: str = "frequency_bin",
                  levels: list[str] = STRATA, site: str = "physical_group_id", key: str = "candidate_id",
                  report: bool = False) -> DataFrame:
    """Hierarchical capacity-aware draw with hash ties.

    Frequency first, then land cover, climate, year, month, then sites; inside a site by hash.
    ``report`` returns the leaf quotas instead of the drawn rows.
    """
    leaf = [top, *levels]
    # An unknown stratum is stratum 0: a NULL would be counted but never joined.
    strata_kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    candidates = candidates.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(strata_kinds[c])) for c in leaf})
    counts = cut_lineage(candidates.groupBy(*leaf, site).agg(F.count(F.lit(1)).alias("n")))
    quotas = frequency_quotas(counts, top, total)
    strata = counts.groupBy(*leaf).agg(F.sum("n").alias("n")).join(quotas.withColumnRenamed("quota", "top_quota"), top)
    leaves = stratum_quotas(strata, top, levels, seed)
    if report:
        return leaves.select(*leaf, F.col("n").alias("capacity"), F.col("_asked").alias("quota"))
    leaves = counts.join(leaves.filter("_asked > 0").select(*leaf, "_asked"), leaf)
    leaves = leaves.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(site))))
    sites = maxmin_allocate(leaves.withColumnRenamed("n", "_capacity"), leaf, "_capacity", "_asked", "_hash")
    wanted = sites.filter("quota > 0").select(*leaf, site, F.col("quota").alias("_quota"))
    # Only rows of strata with a share are ranked.
    rows = candidates.join(wanted, [*leaf, site]).withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    ranked = numbered_by_hash(rows, [*leaf, site], "_hash", "_rank")
    return ranked.filter(F.col("_rank") <= F.col("_quota")).drop("_hash", "_rank", "_quota")


# --- spaced dates -------------------------------------------------------------------------------

def spaced_count(days: Column, gap_days: int) -> Column:
    """Greatest number of dates at least ``gap_days`` apart, from a sorted array of dates."""
    start = F.struct(F.lit(None).cast("date").alias("last"), F.lit(0).cast("bigint").alias("n"))
    def step(acc: Column, day: Column) -> Column:
        take = acc["last"].isNull() | (F.datediff(day, acc["last"]) >= gap_days)
        return F.struct(F.when(take, day).otherwise(acc["last"]).alias("last"),
                        (acc["n"] + F.when(take, 1).otherwise(0)).alias("n"))
    return F.aggregate(days, start, step, lambda acc: acc["n"])


def station_dates(df: DataFrame, station: list[str], day: str) -> DataFrame:
    """Sorted distinct dates per station: bounded by the calendar, not by the rows."""
    return df.select(*station, day).distinct().groupBy(*station).agg(F.array_sort(F.collect_list(day)).alias("days"))


def spaced_capacity(df: DataFrame, station: list[str], day: str, gap_days: int = 30) -> DataFrame:
    return station_dates(df, station, day).select(*station, spaced_count(F.col("days"), gap_days).alias("capacity"))


def greedy_dates(days: Column, gap_days: int, forward: bool = True) -> Column:
    """The greedy spaced subset from the early or the late end."""
    ordered = days if forward else F.reverse(days)
    def step(acc: Column, day: Column) -> Column:
        gap = F.abs(F.datediff(day, F.element_at(acc, -1)))
        return F.when((F.size(acc) == 0) | (gap >= gap_days), F.array_append(acc, day)).otherwise(acc)
    return F.aggregate(ordered, F.array().cast("array<date>"), step)


def maximum_schedule_dates(df: DataFrame, station: list[str], day: str, gap_days: int = 30) -> DataFrame:
    """Dates that belong to at least one largest spaced schedule of their station.

    A date qualifies when the greedy counts before and after it add up to the capacity.
    """
    base = station_dates(df, station, day).withColumn("early", greedy_dates(F.col("days"), gap_days)).withColumn(
        "late", greedy_dates(F.col("days"), gap_days, forward=False))
    rows = base.select(*station, "early", "late", F.size("early").alias("capacity"), F.explode("days").alias(day))
    before = F.size(F.filter("early", lambda d: F.datediff(F.col(day), d) >= gap_days))
    after = F.size(F.filter("late", lambda d: F.datediff(d, F.col(day)) >= gap_days))
    return rows.withColumn("feasible", before + 1 + after == F.col("capacity")).select(*station, day, "capacity", "feasible")


#: Visits of a site in one row of places; a site with more in a month has several rows.
VISITS = 1024
#: Rows of a station that one task takes whole, which is what a task is dealt too, and rows of a month's sites that are placed in one group.
STATION_ROWS, PLACED = 1 << 20, 1 << 18


def _rotation_paths(top: str, site: str) -> list[list[str]]:
    months = [top, "landcover", "climate_class", "year", "month"]
    return [[*months, site], months, months[:4], months[:3], months[:1]]


def _rotation_counts(df: DataFrame, top: str, site: str) -> dict[str, DataFrame]:
    """Candidates of the sites of each month, and what follows from that table: the positions of a rotation depend on counts alone."""
    paths = _rotation_paths(top, site)
    leaves = written(df.groupBy(*paths[0]).agg(F.count(F.lit(1)).alias("n")), "leaves")
    stations = leaves.groupBy(site).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min(top).alias("low"), F.max(top).alias("high"))
    out, below = {"leaves": leaves, "stations": written(stations, "stations")}, leaves
    for name, path in zip(("months", "years", "spaces"), paths[1:]):
        below = out[name] = written(below.groupBy(*path).agg(F.sum("n").alias("n")), name)
    return out


def _children(counts: DataFrame, path: list[str], parent: list[str], seed: int, level: int) -> DataFrame:
    """Beside each child the counts of all children of its parent in hash order, ``_n``, and its own place in that list, ``_i``: strata are few."""
    own = F.struct(K.hash_rank(seed, K.canonical_list(*[F.col(c) for c in path])).alias("h"), *path, "n")
    listed = counts.withColumn("_own", own).withColumn("_all", F.array_sort(F.collect_list("_own").over(Window.partitionBy(*parent))))
    return listed.select(*path, F.transform("_all", lambda c: c["n"]).alias(f"_n{level}"), F.array_position("_all", F.col("_own")).alias(f"_i{level}"))


def _risen(visit: np.ndarray, sizes: np.ndarray, many: np.ndarray, early_sizes: np.ndarray, early_many: np.ndarray) -> np.ndarray:
    """Positions among children of ``sizes`` rows, ``many`` of each: all rows of earlier visits, then those of the same visit of the early children."""
    def upto(weights: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(weights)])
    order, first = np.argsort(sizes), np.argsort(early_sizes)
    sizes, many, early_sizes, early_many = sizes[order], many[order], early_sizes[first], early_many[first]
    at = np.searchsorted(sizes, visit - 1, side="right")
    rows = upto(sizes * many)[at] + (visit - 1) * (many.sum() - upto(many)[at])
    return rows + early_many.sum() - upto(early_many)[np.searchsorted(early_sizes, visit, side="left")]


def _placed(sites: pa.Table, info: pa.Table) -> pa.Table:
    """Positions in the bin of every visit of some sites of a year's months; ``info`` tells of each month the levels above and, where it is cut, its other slices."""
    months = sites["month"].combine_chunks().dictionary_encode(null_encoding="encode")
    number = months.indices.to_numpy()
    order = np.lexsort((np.array(sites["_hash"].to_pylist(), dtype="S32"), number))
    sites, number = sites.take(pa.array(order)), number[order]
    sizes = sites["_size"].to_numpy()
    ends, known = np.concatenate([[0], np.cumsum(sizes)]), {row["month"]: row for row in info.to_pylist()}
    place = np.empty(ends[-1], np.int64)
    for code, month in enumerate(months.dictionary.to_pylist()):
        start, end = np.searchsorted(number, [code, code + 1])
        place[ends[start]:ends[end]] = _month_places(sizes[start:end], known[month])
    at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int64()))
    return sites.drop_columns(["_hash", "_size", "_slice"]).append_column("_at", at)


def _month_places(sizes: np.ndarray, info: dict) -> np.ndarray:
    """Positions in the bin of the visits of a month's sites in hash order, one site after the other."""
    visit = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # In the order of visits, then hashes, the sites with so many visits follow each other.
    turns = np.argsort(visit, kind="stable")
    place = np.empty(len(visit), np.int64)
    place[turns] = np.arange(1, len(visit) + 1)
    if info["_slices"]:
        cut = np.array([[s["slice"], s["size"], s["many"]] for s in info["_slices"]], np.int64)
        lower = cut[cut[:, 0] < info["_slice"]]
        starts = np.searchsorted(visit[turns], visit, side="left")
        place = place - starts + _risen(visit, cut[:, 1], cut[:, 2], lower[:, 1], lower[:, 2])
    place = place + info["_base"]
    for level in (1, 2, 3):
        counts = np.array(info[f"_n{level}"], np.int64)
        early = counts[:info[f"_i{level}"]]
        place = _risen(place, counts, np.ones_like(counts), early, np.ones_like(early))
    return place


def _rotation_places(counts: dict[str, DataFrame], seed: int, top: str, site: str) -> DataFrame:
    """Positions in the bin of the visits of every site of every month, ``VISITS`` of them a row (``_part``, ``_at``).

    A year's sites are dealt by visits and, where a month has more than ``PLACED`` rows, by hash.
    """
    leaf, month, year, space, whole = _rotation_paths(top, site)
    hashed = K.hash_rank(seed, K.canonical_list(*[F.col(c) for c in leaf]))
    parts = counts["leaves"].withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / VISITS))))
    parts = parts.select(*leaf, "_part", F.least(F.col("n") - F.col("_part") * VISITS, F.lit(VISITS)).cast("bigint").alias("_size"))
    # The table of months is a small file, which Spark sends to all tasks: sites are shuffled once, to where they are placed.
    cuts = counts["months"].select(*month, F.ceil(F.col("n") / PLACED).alias("_cuts"))
    cut = F.least(F.floor(K.hash_unit(hashed) * F.col("_cuts")), F.col("_cuts") - 1)
    dealt = parts.alias("p").join(cuts.alias("s"), same_keys("p", "s", month)).select("p.*", "s._cuts").withColumn("_slice", F.when(F.col("_cuts") > 1, cut).otherwise(0).cast("bigint"))
    group = [*month, "_part"]
    sums = dealt.groupBy(*group).agg(F.sum("_size").alias("_rows"), F.max("_cuts").alias("_cuts"))
    sums = sums.withColumn("_base", F.sum("_rows").over(Window.partitionBy(*month).orderBy("_part")) - F.col("_rows"))
    slices = dealt.filter("_cuts > 1").groupBy(*group, "_slice", "_size").agg(F.count(F.lit(1)).alias("_many")).groupBy(*group).agg(
        F.collect_list(F.struct(F.col("_slice").alias("slice"), F.col("_size").alias("size"), F.col("_many").alias("many"))).alias("_slices"))
    info = sums.alias("a").join(slices.alias("b"), same_keys("a", "b", group), "left").select("a.*", "b._slices")
    for level, (path, parent, name) in enumerate(((month, year, "months"), (year, space, "years"), (space, whole, "spaces")), 1):
        above = _children(counts[name], path, parent, seed, level)
        info = info.alias("a").join(above.alias("b"), same_keys("a", "b", path)).select("a.*", f"b._n{level}", f"b._i{level}")
    info = info.drop("_rows").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cuts") - 1))).drop("_cuts")
    info = info.select(*[F.col(c).alias(c) for c in info.columns])
    # Hashes are worked out where the sites have arrived: they would not be packed.
    group = [*year, "_part", "_slice"]
    sites = spread(dealt.drop("_cuts"), *group).withColumn("_hash", F.unhex(hashed))
    kinds = [dealt.schema[c] for c in [*leaf, "_part"]]
    schema = T.StructType([*kinds, T.StructField("_at", T.ArrayType(T.LongType()))])
    return sites.groupBy(*group).cogroup(info.groupBy(*group)).applyInArrow(_placed, schema)


def _rotated(df: DataFrame, counts: dict[str, DataFrame], seed: int, name: str, top: str, key: str, site: str, also: tuple[str, ...]) -> DataFrame:
    """:func:`picker_positions` of counted candidates. Places travel with the candidates in one shuffle by station, which orders a site's own rows."""
    leaf = _rotation_paths(top, site)[0]
    narrow = [*leaf, key, *also]
    rows, places = df.select(*narrow), _rotation_places(counts, seed, top, site)
    hashed = F.unhex(K.hash_rank(seed, K.quoted(F.col(key))))
    is_wide = F.col("n") > STATION_ROWS
    total, most, some = counts["stations"].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0)), F.count_if(is_wide)).first()
    turn = ((F.col("_visit") - 1) % VISITS + 1).cast("int")
    plain = places
    if some:
        # Stations too large for one task: their rows are dealt by hash and meet their places visit by visit.
        wide = counts["stations"].filter(is_wide).select(site)
        places = written(places, "places")
        large = rows.alias("r").join(wide.alias("w"), same_keys("r", "w", [site]), "left_semi").withColumn("_hash", hashed)
        rows, plain = (t.alias("t").join(wide.alias("w"), same_keys("t", "w", [site]), "left_anti") for t in (rows, places))
    both = spread(rows.unionByName(plain, allowMissingColumns=True), site, least=total // STATION_ROWS)
    both = both.withColumn("_hash", F.when(F.col("_at").isNull(), hashed))
    # Rows of places come first in their leaf, so a candidate's visit is the number of rows before it, but for those of places.
    # The columns that tell most rows apart are compared first.
    keys, first = leaf[::-1], F.col("_hash").asc_nulls_first()
    upto = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_visit", F.count("_hash").over(upto))
    if most > VISITS:
        both = both.withColumn("_part", F.coalesce("_part", F.floor((F.col("_visit") - 1) / VISITS)))
        upto = Window.partitionBy(*keys, "_part").orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_at", F.first("_at").over(upto))
    out = both.filter(F.col("_hash").isNotNull()).select(*narrow, F.element_at("_at", turn).alias(name))
    if some:
        large = numbered(large, leaf, [F.col("_hash")], "_visit", K.hash_bucket(F.hex("_hash"), 2)).withColumn("_part", F.floor((F.col("_visit") - 1) / VISITS))
        met = large.alias("r").join(places.alias("p"), same_keys("r", "p", [*leaf, "_part"])).select("r.*", "p._at")
        out = out.unionByName(met.select(*narrow, F.element_at("_at", turn).alias(name)))
    return out


def picker_positions(df: DataFrame, seed: int, name: str, top: str = "frequency_bin", key: str = "candidate_id",
                     site: str = "physical_group_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Position of each candidate in a nested rotation over strata, years, months and sites of its bin.

    A site's own rows come first by hash; each level above interleaves its children by visit number.
    Only ids and strata (and ``also``) are returned. A child has one row a visit, so above a site's own rows positions follow from counts:
    candidates are counted, and shuffled once.
    """
    return _rotated(df, _rotation_counts(df, top, site), seed, name, top, key, site, also)


def picker_rank(df: DataFrame, seed: int, name: str, top: str = "frequency_bin", key: str = "candidate_id",
                site: str = "physical_group_id") -> DataFrame:
    """Candidates with their :func:`picker_positions`."""
    return df.join(picker_positions(df, seed, name, top, key, site).select(key, name), key)


def _accept_spaced(gap_days: int, full: bool):
    """Per-station acceptance of dates in rank order; the group holds one row per calendar date.

    With ``full`` a date stays open while a largest schedule of its segment holds it: the greedy counts before and after it add up.
    A pick cuts its segment in two, and a date that is not open never becomes so.
    """
    def accept(rows: pa.Table) -> pa.Table:
        time = rows["target_time"].combine_chunks()
        days = pc.fill_null(time.cast(pa.date32()).cast(pa.int32()).cast(pa.int64()), -(1 << 40)).to_numpy(zero_copy_only=False)
        free, place = np.unique(days, return_inverse=True)
        low, high = np.searchsorted(free, free - gap_days, side="right").tolist(), np.searchsorted(free, free + gap_days, side="left").tolist()
        open_, segment = [True] * len(free), [(0, len(free))] * len(free)

        def settle(start: int, end: int) -> None:
            segment[start:end] = [(start, end)] * (end - start)
            early, i = [], start
            while i < end:
                early.append(i)
                i = high[i]
            if len(early) <= 1:
                return
            late, i = [], end - 1
            while i >= start:
                late.append(i)
                i = low[i] - 1
            before, after = 0, len(late)
            for i in range(start, end):
                while before < len(early) and early[before] < low[i]:
                    before += 1
                while after and late[after - 1] < high[i]:
                    after -= 1
                open_[i] = before + 1 + after == len(early)

        # Without a gap every date is kept.
        cutting = full and gap_days > 0
        if cutting:
            settle(0, len(free))
        keep, place = np.zeros(len(days), bool), place.tolist()
        for row in pc.sort_indices(rows["rank"]).to_pylist():
            i = place[row]
            if not open_[i]:
                continue
            keep[row] = True
            start, end = segment[i]
            open_[low[i]:high[i]] = [False] * (high[i] - low[i])
            if cutting:
                settle(start, min(low[i], end))
                settle(max(high[i], start), end)
        return rows.filter(pa.array(keep))
    return accept


def _spaced_rows(ranked: DataFrame, station: list[str], rank: str, gap_days: int, full: bool) -> DataFrame:
    """Station, date, ``rank`` and id of the rows that :func:`spaced_picks` accepts."""
    best = ranked.groupBy(*station, "target_time").agg(F.min(F.struct(F.col(rank), F.col("candidate_id"))).alias("_b"))
    best = best.select(*station, "target_time", F.col(f"_b.{rank}").alias("rank"), F.col("_b.candidate_id").alias("candidate_id"))
    return best.groupBy(*station).applyInArrow(_accept_spaced(gap_days, full), best.schema)


def spaced_picks(ranked: DataFrame, station: list[str], rank: str, gap_days: int, full: bool = False) -> DataFrame:
    """Accept candidates in rank order unless a station date lies within the gap.

    ``full`` also refuses a date that would lower the station's capacity, so the draw ends with
    exactly the maximum. Candidates of one station and date conflict with each other, so only the
    best of each date goes to the per-station step: its group is bounded by the calendar.
    """
    taken = _spaced_rows(ranked, station, rank, gap_days, full)
    return ranked.join(taken.select("candidate_id"), "candidate_id", "left_semi")


def capacity_picks(candidates: DataFrame, seed: int, gap_days: int = 30, station: str = "physical_group_id") -> DataFrame:
    """Bin, station, date, id and ``draw_rank`` of the rows of :func:`capacity_draw`: they leave the shuffle by station as they are."""
    counts = _rotation_counts(candidates, "frequency_bin", station)
    spanning = counts["stations"].filter("low <> high").select(station).limit(1).collect()
    if spanning:
        raise ValueError(f"a station lies in several bins, for instance {spanning[0][station]}")
    ranked = _rotated(candidates, counts, seed, "draw_rank", "frequency_bin", "candidate_id", station, ("target_time",))
    return _spaced_rows(ranked, [station, "frequency_bin"], "draw_rank", gap_days, True).withColumnRenamed("rank", "draw_rank")


def capacity_draw(candidates: DataFrame, seed: int, gap_days: int = 30, station: str = "physical_group_id") -> DataFrame:
    """Spaced draw that reaches every bin's exact capacity, ordered by the nested rotation. A station may lie in one bin only."""
    return candidates.join(capacity_picks(candidates, seed, gap_days, station).select("candidate_id", "draw_rank"), "candidate_id")


#: Levels below the bin, the least filled first: the space, its years, their months.
PICK_LEVELS = (("landcover", "climate_class"), ("year",), ("month",))


def _round_shares(pool: DataFrame, taken: DataFrame, open_: DataFrame, station: str, seed: int) -> DataFrame:
    """How many candidates of each station in each leaf the bins' open quotas ask for, given what has been taken."""
    leaf = ["frequency_bin", *[c for level in PICK_LEVELS for c in level]]
    there = written(pool.groupBy(*leaf, station).agg(F.count(F.lit(1)).alias("n")), "there")
    had = taken.groupBy(*leaf).agg(F.count(F.lit(1)).alias("had"))
    strata = there.groupBy(*leaf).agg(F.sum("n").alias("n")).join(had, leaf, "full").na.fill(0, ["n", "had"])
    current = written(strata.join(open_, "frequency_bin"), "shares")
    path = ["frequency_bin"]
    for level in PICK_LEVELS:
        nodes = current.groupBy(*path, *level).agg(F.sum("n").alias("_capacity"), F.sum("had").alias("_had"), F.max("_asked").alias("_total"))
        nodes = nodes.withColumn("_hash", K.hash_rank(seed, *[F.col(c) for c in [*path, *level]]))
        shares = maxmin_top_up(nodes, path, "_had", "_capacity", "_total", "_hash")
        path = [*path, *level]
        current = written(current.drop("_asked").join(shares.select(*path, F.col("quota").alias("_asked")), path), "shares")
    leaves = there.join(current.filter("_asked > 0").select(*leaf, "_asked"), leaf)
    # A station counts in its bin as a whole, not in the leaf.
    mine = taken.groupBy("frequency_bin", station).agg(F.count(F.lit(1)).alias("_had"))
    leaves = leaves.join(mine, ["frequency_bin", station], "left").na.fill(0, ["_had"]).withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(station))))
    out = maxmin_top_up(leaves, leaf, "_had", "n", "_asked", "_hash")
    return out.filter("quota > 0").select(*leaf, station, F.col("quota").alias("_share"))


def stratified_pick(candidates: DataFrame, quotas: DataFrame, seed: int, gap_days: int, admissible: Column | None = None,
                    station: str = "physical_group_id", taken: DataFrame | None = None) -> DataFrame:
    """Spaced, balanced picks up to a quota per bin; the date gap of a station holds across bins.

    ``quotas`` has ``frequency_bin`` and ``quota``. Every round levels the spaces, years, months and stations up from what has been
    taken so far, takes the rows of those shares that keep the gap, the least filled bin first, and drops what
    no longer keeps it. So siblings differ by more than one only where the lesser has no eligible row left. A round takes at
    least one row where any is left. ``taken`` (rows like ``candidates``) counts against quotas, balance and gaps from the start.
    ``draw_order`` numbers the picks of a bin. NULL strata are stratum 0.
    """
    leaf = ["frequency_bin", *[c for level in PICK_LEVELS for c in level]]
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    known = {c: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for c in leaf}
    narrow = [*leaf, station, "target_time", "candidate_id"]
    rows = (candidates if admissible is None else candidates.filter(admissible)).withColumns(known)
    before = rows.select(*narrow).limit(0) if taken is None else taken.withColumns(known).select(*narrow)
    had = before.groupBy("frequency_bin").agg(F.count(F.lit(1)).alias("_n"))
    if quotas.join(had, "frequency_bin", "left").filter(F.col("quota") > F.coalesce("_n", F.lit(0))).isEmpty():
        return candidates.limit(0).select("candidate_id", *[c for c in candidates.columns if c != "candidate_id"], F.lit(0).cast("bigint").alias("draw_order"))
    done = written(before.withColumns({"_round": F.lit(0), "_hash": F.lit("")}), "picks")
    pool, turn = None, 0
    while True:
        turn += 1
        have = done.groupBy("frequency_bin").agg(F.count(F.lit(1)).alias("_n"))
        open_ = quotas.join(have, "frequency_bin", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("quota > _n")
        # One row per bin; its place among the bins decides who goes first where dates of a station meet.
        place = F.row_number().over(Window.orderBy(F.col("_n") / F.col("quota"), "frequency_bin"))
        open_ = written(open_.select("frequency_bin", (F.col("quota") - F.col("_n")).alias("_asked"), place.alias("_place")), "open")
        if pool is None:
            # Bins that are full from the start give nothing: their rows are not kept. The rest is written once, without its hash.
            pool = rows.select(*narrow).join(open_.select("frequency_bin"), "frequency_bin", "left_semi").join(done.select("candidate_id"), "candidate_id", "left_anti")
            pool = written(_apart_from(pool, done, station, gap_days), "pool")
        if open_.isEmpty():
            break
        # Each round reads that table and leaves out what lies near a pick; the picks are few and told by their dates.
        new = done.filter("_round > 0")
        left = pool if turn == 1 else _apart_from(pool.join(new.select("candidate_id"), "candidate_id", "left_anti"), new, station, gap_days)
        shares = written(_round_shares(left, done, open_.drop("_place"), station, seed), "shares")
        picked = left.join(shares, [*leaf, station]).withColumn("_hash", K.hash_rank(seed, K.quoted(F.col("candidate_id"))))
        picked = numbered_by_hash(picked, [*leaf, station], "_hash", "_rank").filter("_rank <= _share")
        picked = picked.join(open_.select("frequency_bin", "_place"), "frequency_bin").withColumn("_order", F.concat(F.lpad(F.col("_place").cast("string"), 9, "0"), "_hash"))
        picks = written(spaced_picks(written(picked, "rows"), [station], "_order", gap_days).select(*narrow, "_hash", F.lit(turn).alias("_round")), "picks")
        if picks.isEmpty():
            break
        done = done.unionByName(picks)
    new = done.filter("_round > 0").select("candidate_id", "frequency_bin", "_round", "_hash")
    order = numbered(new, ["frequency_bin"], [F.col("_round"), F.col("_hash")], "draw_order", F.col("_round") * 4096 + K.hash_bucket(F.col("_hash"), 3))
    return candidates.join(order.select("candidate_id", "draw_order"), "candidate_id")


def _apart_from(pool: DataFrame, picks: DataFrame, station: str, gap_days: int) -> DataFrame:
    """Rows whose station has no pick within the gap; a station has at most one pick a gap, so its dates are few."""
    dates = picks.groupBy(station).agg(F.collect_set("target_time").alias("_dates"))
    near = F.exists("_dates", lambda d: F.abs(F.datediff(d, F.col("target_time"))) < gap_days)
    return pool.join(dates, station, "left").filter(~F.coalesce(near, F.lit(False))).drop("_dates")


def refill_plan(candidates: DataFrame, attempts: DataFrame, quotas: DataFrame, seed: int, gap_days: int = 30,
                station: str = "physical_group_id") -> DataFrame:
    """Candidates to attempt next: none attempted before, up to each bin's quota less its successes, apart from their dates.

    ``attempts``: candidate_id, success. A failed attempt fills no quota and blocks no date.
    """
    won = candidates.join(attempts.filter("success").select("candidate_id").distinct(), "candidate_id", "left_semi")
    tried = attempts.select("candidate_id").distinct()
    return stratified_pick(candidates.join(tried, "candidate_id", "left_anti"), quotas, seed, gap_days, station=station, taken=won)


def _month_diverse(gap_days: int, limit: int):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_hash").reset_index(drop=True)
        stamp = pd.to_datetime(rows["target_time"])
        day = (stamp.astype("datetime64[s]").astype("int64") // 86400).to_numpy()
        month = stamp.dt.month.to_numpy()
        open_, used, order = np.ones(len(rows), bool), np.zeros(13, int), []
        while open_.any() and len(order) < limit:
            at = np.flatnonzero(open_)
            i = at[np.argmin(used[month[at]])]
            order.append(i)
            used[month[i]] += 1
            open_ &= np.abs(day - day[i]) >= gap_days
            open_[i] = False
        return rows.iloc[order].drop(columns="_hash").assign(pick=range(1, len(order) + 1))
    return pick


def month_diverse_windows(df: DataFrame, station: list[str], gap_days: int, limit: int = 1 << 30, seed: int = 43) -> DataFrame:
    """Per station, repeatedly a window of the least-used month, in seeded order; dates keep the gap. A group has a row per date."""
    days = df.select(*station, "target_time").distinct()
    schema = T.StructType([*days.schema.fields, T.StructField("pick", T.LongType())])
    hashed = days.withColumn("_hash", K.hash_rank(seed, *[K.quoted(F.col(c)) for c in station], K.quoted(F.date_format("target_time", "yyyy-MM-dd"))))
    return hashed.groupBy(*station).applyInPandas(_month_diverse(gap_days, limit), schema)


# --- greedy exclusion ---------------------------------------------------------------------------

def conflict_free(df: DataFrame, key: str, rank: str, x: str, y: str, day: str, reach_m: float = 1200.0,
                  gap_days: int = 40, zone: str | None = None, max_dates: int | None = None) -> DataFrame:
    """Sequential greedy acceptance by ``rank`` without the sequence.

    A row conflicts with an accepted one when both offsets are under ``reach_m`` and the dates are
    under ``gap_days`` apart; a location keeps at most ``max_dates``. Each round accepts every row
    that is the lowest undecided rank in its own and all neighbouring buckets (and at its location),
    then drops what conflicts with the accepted rows. Only bucket minima are compared, never all
    pairs of a bucket, and the accepted set equals the sequential one. Expected rounds grow with
    the logarithm of the table; every round is checkpointed.

    Rows of one place and day conflict with each other and with the same others, so only the lowest rank of each takes part.
    A row without place or day is not accepted.
    """
    zones = [zone] if zone else []
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = df.select(key, F.col(rank).alias("_rank"), *zones, F.col(x).alias("_x"), F.col(y).alias("_y"), number.alias("_d"))
    rows = rows.withColumn("_bx", F.floor(F.col("_x") / reach_m)).withColumn("_by", F.floor(F.col("_y") / reach_m)
               ).withColumn("_bt", F.floor(F.col("_d") / gap_days))
    cell, place = [*zones, "_bx", "_by", "_bt"], [*zones, "_x", "_y"]
    rows = rows.filter(F.col("_bx").isNotNull() & F.col("_by").isNotNull() & F.col("_bt").isNotNull())
    lowest = rows.groupBy(*place, "_d", "_bx", "_by", "_bt").agg(F.min(F.struct("_rank", key)).alias("_first"))
    rows = lowest.select(F.col(f"_first.{key}").alias(key), "_first._rank", *place, "_d", "_bx", "_by", "_bt")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])

    def spread(t: DataFrame) -> DataFrame:
        out = t.withColumn("_o", F.explode(around))
        for c, o in (("_bx", "i"), ("_by", "j"), ("_bt", "k")):
            out = out.withColumn(c, F.col(c) + F.col(f"_o.{o}"))
        return out.drop("_o")

    undecided, accepted = cut_lineage(rows), None
    while not undecided.isEmpty():
        lows = undecided.groupBy(*cell).agg(F.min("_rank").alias("_low"))
        near = spread(lows).groupBy(*cell).agg(F.min("_low").alias("_near"))
        first = undecided.join(near, cell).filter(F.col("_rank") == F.col("_near"))
        if max_dates is not None:
            heads = undecided.groupBy(*place).agg(F.min("_rank").alias("_head"))
            first = first.join(heads, place).filter(F.col("_rank") == F.col("_head")).drop("_head")
        new = cut_lineage(first.drop("_near"))
        accepted = new if accepted is None else cut_lineage(accepted.unionByName(new))
        a = spread(new).select(*cell, F.col("_x").alias("_ax"), F.col("_y").alias("_ay"), F.col("_d").alias("_ad"), F.lit(True).alias("_hit"))
        rest = undecided.join(new.select(key), key, "left_anti").alias("u")
        clash = ((F.abs(F.col("u._x") - F.col("a._ax")) < reach_m) & (F.abs(F.col("u._y") - F.col("a._ay")) < reach_m)
                 & (F.abs(F.col("u._d") - F.col("a._ad")) < gap_days))
        same = same_keys("u", "a", cell)
        rest = rest.join(a.alias("a"), same & clash, "left_anti")
        if max_dates is not None:
            done = accepted.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max_dates).drop("_n")
            rest = rest.join(done, place, "left_anti")
        undecided = cut_lineage(rest.select(*undecided.columns))
    if accepted is None:
        return df
    return df.join(accepted.select(key), key, "left_semi")


# --- samples and holdouts -----------------------------------------------------------------------

def diverse_visits(df: DataFrame, seed: int, group: str, key: str = "sample_id", day: str = "target_time") -> DataFrame:
    """Hash order, then visits within (group, season), then visits within the group."""
    from landtally.functions.calendar import season

    out = df.withColumn("order_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    out = out.withColumn("season", season(F.col(day)))
    out = numbered_by_hash(out, [group, "season"], "order_hash", "season_visit")
    return numbered(out, [group], [F.col("season_visit"), F.col("order_hash")], "spatial_visit",
                    visit_bucket(F.col("season_visit"), F.col("order_hash")))


def nested_subset(df: DataFrame, fraction: float, seed: int, group: str, stratum: str, labels: list[str],
                  minimum: int = 64, preserve_groups: bool = False, key: str = "sample_id") -> DataFrame:
    """First ceil(n * fraction) of each stratum in diverse order, with label floors; nested across fractions."""
    base = cut_lineage(diverse_visits(df, seed, group, key))
    order = [F.col("spatial_visit"), F.col("order_hash")]
    bucket = visit_bucket(F.col("spatial_visit"), F.col("order_hash"))
    ranked = numbered(base, [stratum], order, "_stratum_rank", bucket)
    sizes = base.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    keep = F.col("_stratum_rank") <= F.ceil(F.col("_size") * fraction)
    ranked = ranked.join(sizes, stratum)
    for label in labels:
        has = f"_has_{label}"
        ranked = numbered(ranked.withColumn(has, F.col(label) > 0), [has], order, f"_rank_{label}", bucket)
        keep = keep | (F.col(has) & (F.col(f"_rank_{label}") <= minimum))
    if preserve_groups:
        keep = keep | (F.col("spatial_visit") == 1)
    return ranked.filter(keep).select(*df.columns, "spatial_visit", "order_hash")


def proportional_sample(df: DataFrame, strata: list[str], limit: int, seed: int, key: str = "sample_id") -> DataFrame:
    """Largest-remainder quotas per stratum, hash rank inside."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    exact = F.lit(float(limit)) * F.col("_n") / F.sum("_n").over(Window.partitionBy())
    quotas = largest_remainder(counts, [], exact, F.lit(limit), [F.col(s) for s in strata]).drop("_n")
    ranked = numbered_by_hash(df.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key)))), strata, "_hash", "_rank")
    return ranked.join(quotas, strata).filter(F.col("_rank") <= F.col("quota")).drop("_hash", "_rank", "quota")


def extend_snapshot(df: DataFrame, previous: DataFrame, strata: list[str], limit: int, seed: int,
                    key: str = "sample_id") -> DataFrame:
    """Grow a published subset to ``limit``: old rows stay, new rows fill the stratum quotas."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    exact = F.lit(float(limit)) * F.col("_n") / F.sum("_n").over(Window.partitionBy())
    quotas = largest_remainder(counts, [], exact, F.lit(limit), [F.col(s) for s in strata]).drop("_n")
    old = df.join(previous.select(key), key, "left_semi")
    held = old.groupBy(*strata).agg(F.count(F.lit(1)).alias("_held"))
    fresh = df.join(previous.select(key), key, "left_anti").withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    ranked = numbered_by_hash(fresh, strata, "_hash", "_rank").join(quotas, strata).join(held, strata, "left")
    added = ranked.filter(F.col("_rank") <= F.col("quota") - F.coalesce("_held", F.lit(0)))
    return old.withColumn("status", F.lit("kept")).unionByName(added.select(*df.columns).withColumn("status", F.lit("added")))


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` keys with replacement, proportional to ``weight``, from hash-derived uniforms.

    Rows in hash order own stretches of the total weight. The totals of 65,536 buckets of the hash tell where each bucket begins, and only
    rows of buckets in which a draw falls are put in order. Stretches and draws meet by equality of a grid cell of mean width: a
    row or bucket has a cell or two, a draw has one.
    """
    base = df.filter(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w")).withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    base = base.withColumn("_b", K.hash_bucket(F.col("_hash")))
    buckets = cut_lineage(base.groupBy("_b").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n")))
    begins = cut_lineage(running_before(buckets, [], [F.col("_b")], "_w", "_lo", F.floor(F.col("_b") / 4096)))
    # The total is the end of the last bucket, so that the stretches leave nothing over.
    total, rows, count = begins.agg(F.coalesce(F.max(F.col("_lo") + F.col("_w")), F.lit(0.0)), F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()

    def met(spans: DataFrame, at: DataFrame, many: int, on: list[str]) -> DataFrame:
        width = total / max(1, many)
        cell = lambda place: F.floor(place / F.lit(width or 1.0))
        wide = spans.withColumn("_hi", F.col("_lo") + F.col("_w")).withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
        return at.withColumn("_cell", cell(F.col("_at"))).join(wide, [*on, "_cell"]).filter((F.col("_at") > F.col("_lo")) & (F.col("_at") <= F.col("_hi")))
    at = F.least(K.hash_unit(K.fingerprint(seed, K.quoted(F.lit("draw")), F.col("id"))) * F.lit(total), F.lit(total))
    unit = df.sparkSession.range(1, (draws if rows else 0) + 1).select(F.col("id").alias("draw"), at.alias("_at"))
    falls = cut_lineage(met(begins.select("_b", "_lo", "_w"), unit, count, []).select("draw", "_at", "_b"))
    hit = falls.select("_b").distinct().join(begins.select("_b", F.col("_lo").alias("_begin")), "_b")
    # Bounded by the number of buckets.
    near = base.join(F.broadcast(hit), "_b")
    placed = running_before(near, ["_b"], [F.col("_hash")], "_w", "_own", F.lit(0)).withColumn("_lo", F.col("_begin") + F.col("_own"))
    return met(placed.select(key, "_b", "_lo", "_w"), falls, rows, ["_b"]).select("draw", key)


def population_priority(df: DataFrame, strata: list[str], population: str, seed: int, key: str = "sample_id") -> DataFrame:
    """-ln(u) / (population / rows in the stratum): ascending order samples in proportion to population."""
    local = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_local"))
    u = K.hash_unit(K.fingerprint(seed, K.quoted(F.col(key))))
    out = df.join(local, strata)
    weight = F.col(population) / F.col("_local")
    return out.withColumn("priority", -F.log(F.greatest(u, F.lit(1e-12))) / weight).drop("_local")


def quantile_probe(df: DataFrame, size: str, key: str, count: int) -> DataFrame:
    """``count`` rows at evenly spaced ranks of (size, key)."""
    ranked = numbered_overall(df, [F.col(size), F.col(key)], "_rank")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(max(count - 1, 1))
    spots = total.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_i"), "_n").select(
        (F.bround(F.col("_i") * step) + 1).cast("bigint").alias("_rank")).distinct()
    return ranked.join(F.broadcast(spots), "_rank").withColumnRenamed("_rank", "position")


def head_per_group(df: DataFrame, site: list[str], stratum: list[str], per_site: int, per_stratum: int,
                   seed: int, key: str = "sample_id") -> DataFrame:
    """At most ``per_site`` rows per site in a stratum, then at most ``per_stratum``, in hash order."""
    hashed = df.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    near = numbered(hashed, [*stratum, *site], [F.col("_hash")], "_site_rank").filter(F.col("_site_rank") <= per_site)
    out = numbered(near, stratum, [F.col("_hash")], "_rank").filter(F.col("_rank") <= per_stratum)
    return out.drop("_hash", "_site_rank", "_rank")


def equal_bin_head(df: DataFrame, bin_: str, rank: str) -> DataFrame:
    """First n rows of every bin in ``rank`` order, n being the smallest nonempty bin."""
    smallest = df.groupBy(bin_).count().agg(F.min("count").alias("_n"))
    ranked = numbered(df, [bin_], [F.col(rank)], "_rank", F.floor(F.col(rank) / 65536))
    return ranked.filter(F.col("_rank") <= smallest.scalar()).drop("_rank")


def equal_bin_head_by_hash(df: DataFrame, bin_: str, hashed: str) -> DataFrame:
    """:func:`equal_bin_head` in the order of a hash, of which only the rows near the cut are ranked."""
    return first_by_hash(df, [bin_], hashed, F.col("_least"))


def block_sample(df: DataFrame, block: list[str], stratum: str, per_class: int, seed: int, key: str = "sample_id") -> DataFrame:
    """``per_class`` rows of each class in each block, by hash; blocks come back in shuffled order."""
    hashed = df.withColumn("_hash", K.hash_rank(seed, K.quoted(F.col(key))))
    out = numbered(hashed, [*block, stratum], [F.col("_hash")], "draw").filter(F.col("draw") <= per_class)
    return out.withColumn("block_order", K.hash_rank(seed, K.quoted(F.concat_ws(":", *block)))).drop("_hash")


def split_deficits(df: DataFrame, split: str, added: int) -> DataFrame:
    """Rows each split still lacks for 70/15/15 of total + added; halves round to even."""
    total = df.agg((F.count(F.lit(1)) + F.lit(added)).alias("_t"))
    have = df.groupBy(split).agg(F.count(F.lit(1)).alias("present"))
    names = df.sparkSession.createDataFrame([(s,) for s in K.SPLITS], f"{split} string")
    part = F.bround(F.col("_t") * F.lit(0.15)).cast("bigint")
    target = F.when(F.col(split) == "train", F.col("_t") - part * 2).otherwise(part)
    out = names.withColumn("_t", total.scalar()).withColumn("target", target).join(have, split, "left")
    present = F.coalesce("present", F.lit(0))
    return out.select(split, present.alias("present"), "target", (F.col("target") - present).alias("deficit"))


def block_holdout(df: DataFrame, block: Column, fraction: float, seed: int) -> DataFrame:
    """The first ceil(n * fraction) blocks by hash go to development."""
    keyed = df.withColumn("block", block)
    blocks = keyed.select("block").distinct().withColumn("_hash", K.hash_rank(seed, K.quoted(F.col("block"))))
    ranked = numbered_by_hash(blocks, [], "_hash", "_rank")
    count = blocks.agg(F.count(F.lit(1)).alias("_n"))
    cut = ranked.select("block", (F.col("_rank") <= F.ceil(count.scalar() * fraction)).alias("development"))
    return keyed.join(cut, "block")
