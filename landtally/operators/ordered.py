"""Order-dependent primitives that never put one whole hot group into one task.

A plain ``row_number`` sorts each group in a single task. Where a group may hold a large share
of the table, the functions here split it by a *bucket* column that grows with the order:
positions inside a bucket are local, and the start of each bucket comes from a small table of
bucket counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from landtally.functions.keys import hash_bucket
from landtally.session import cut_lineage

_BEFORE = (Window.unboundedPreceding, -1)


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """NULL-safe equality of key columns between two aliased tables."""
    parts = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def visit_bucket(visit: Column, hashed: Column) -> Column:
    """Bucket for the order (visit, hash): hash slices for early visits, log-spaced ranges for late ones."""
    early = visit * 4096 + hash_bucket(hashed, 3)
    late = F.lit(4097 * 4096) + F.floor((F.log2(visit.cast("double")) - 12) * 4096)
    return F.when(visit <= 4096, early).otherwise(late).cast("bigint")


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str,
             bucket: Column | None = None) -> DataFrame:
    """``row_number`` within ``groups``; with ``bucket`` the group may be of any size.

    ``bucket`` must not decrease along ``order``. Without it, use only where a group is bounded
    or where a following ``name <= k`` filter lets Spark keep k rows per group before the shuffle.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    keyed = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    starts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).withColumn(
        "_start", F.coalesce(F.sum("_size").over(
            Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)))
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = local.alias("l").join(starts.alias("s"), same_keys("l", "s", keys))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns],
                         (F.col("l._local") + F.col("s._start")).alias(name))


def numbered_overall(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row_number`` over the whole table. The order must be total.

    A range shuffle splits even a value that many rows share, because the order goes on to the key.
    Ranges are written once, so every later read sees the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    return numbered(ranged, [], order, name, F.col("_range")).drop("_range")


def numbered_by_hash(df: DataFrame, groups: list[str], hashed: str, name: str) -> DataFrame:
    return numbered(df, groups, [F.col(hashed)], name, hash_bucket(F.col(hashed)))


def first_by_hash(df: DataFrame, groups: list[str], hashed: str, most: Column) -> DataFrame:
    """The first ``most`` rows of each group in hash order, without sorting the rest.

    Buckets of the hash are counted. Those that end within the limit are taken whole, and only the bucket in which it falls is
    ranked: a few of 65,536. ``most`` may use the group's ``_total`` and the least total of any group, ``_least``.
    """
    keyed = df.withColumn("_bucket", hash_bucket(F.col(hashed)))
    counts = cut_lineage(keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size")))
    total = counts.groupBy(*groups).agg(F.sum("_size").alias("_total"))
    limits = total.withColumn("_least", total.agg(F.min("_total")).scalar()).select(*groups, most.alias("_most"))
    along = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum("_size").over(along)).alias("c").join(limits.alias("m"), same_keys("c", "m", groups)).select("c.*", "m._most")
    # The first bucket that goes beyond the limit; a group without one is taken whole.
    over = F.when(F.col("_end") > F.col("_most"), F.struct("_bucket", (F.col("_most") - F.col("_end") + F.col("_size")).alias("left")))
    cuts = cut_lineage(ends.groupBy(*groups).agg(F.min(over).alias("_cut")).select(*groups, F.col("_cut._bucket").alias("_at"), F.col("_cut.left").alias("_left")))
    placed = _beside(keyed, cuts, groups, ["_at", "_left"])
    whole = placed.filter(F.col("_at").isNull() | (F.col("_bucket") < F.col("_at")))
    edge = numbered(placed.filter(F.col("_bucket") == F.col("_at")), groups, [F.col(hashed)], "_rank").filter(F.col("_rank") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def neighbour(df: DataFrame, keys: list[str], time: str, value: str, name: str, bucket_s: int,
              ahead: bool = True) -> DataFrame:
    """``lead``/``lag`` of ``value`` by ``time`` within ``keys``, split into time buckets."""
    keyed = df.withColumn("_bucket", F.floor(F.col(time) / bucket_s))
    parts = [*keys, "_bucket"]
    step = F.lead if ahead else F.lag
    edge = F.min if ahead else F.max
    edges = keyed.groupBy(*parts).agg(edge(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("_edge"))
    edges = edges.withColumn("_next", step("_edge").over(Window.partitionBy(*keys).orderBy("_bucket")))
    local = keyed.withColumn("_near", step(value).over(Window.partitionBy(*parts).orderBy(time, value)))
    local = local.withColumn("_last", step(F.lit(True)).over(Window.partitionBy(*parts).orderBy(time, value)).isNull())
    joined = local.alias("l").join(edges.alias("e"), same_keys("l", "e", parts))
    found = F.when(F.col("l._last"), F.col("e._next.v")).otherwise(F.col("l._near"))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], found.alias(name))


def asof_backward(left: DataFrame, events: DataFrame, keys: list[str], left_time: str, event_time: str,
                  values: list[str], tie: list[str] = (), bucket: float = 600.0,
                  max_age: float | None = None) -> DataFrame:
    """Last event at or before each left row. An event whose value is NULL still counts: it invalidates.

    History before a bucket arrives as one carried event per (key, bucket), so the sort inside a
    task covers one key and one bucket only.
    """
    payload = F.struct(F.col(event_time).alias("_t"), *[F.col(c) for c in tie], *[F.col(c) for c in values])
    ev = events.select(*keys, F.col(event_time).alias("_at"), payload.alias("_event"))
    ev = ev.withColumn("_bucket", F.floor(F.col("_at") / bucket))
    lf = left.withColumn("_bucket", F.floor(F.col(left_time) / bucket))
    parts = [*keys, "_bucket"]
    latest = ev.groupBy(*parts).agg(F.max("_event").alias("_latest"))
    wanted = lf.select(*parts).distinct()
    # Buckets with rows or events, in order: the latest event of any earlier bucket.
    timeline = wanted.withColumn("_latest", F.lit(None).cast(latest.schema["_latest"].dataType)).unionByName(latest)
    timeline = timeline.groupBy(*parts).agg(F.max("_latest").alias("_latest")).withColumn(
        "_carried", F.last("_latest", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*_BEFORE)))
    rows = lf.withColumn("_at", F.col(left_time)).withColumn("_side", F.lit(1))
    marks = ev.withColumn("_side", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_side"), F.col("_event")]
    seen = F.last("_event", ignorenulls=True).over(
        Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_seen", seen).filter("_side = 1").alias("b")
    joined = both.join(timeline.alias("c"), same_keys("b", "c", parts), "left")
    event = F.coalesce(F.col("b._seen"), F.col("c._carried"))
    out = joined.select(*[F.col(f"b.{c}") for c in left.columns], event.alias("_hit"))
    fresh = F.lit(True) if max_age is None else F.col(left_time) - F.col("_hit._t") <= max_age
    return out.select(*left.columns, F.when(fresh, F.col("_hit._t")).alias(event_time),
                      *[F.when(fresh, F.col(f"_hit.{v}")).alias(v) for v in values])


def _with(rows: DataFrame, side: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Rows with the columns ``extra`` of a table that holds each key once; without keys the table is one row."""
    if not keys:
        return rows.join(F.broadcast(side.select(*extra)), F.lit(True))
    return rows.alias("d").join(side.alias("s"), same_keys("d", "s", keys)).select("d.*", *[f"s.{c}" for c in extra])


#: Rows up to which a side table, counted first, is sent to all tasks, and parts of a group where it is not.
SMALL, PARTS = 4096, 32


def _beside(rows: DataFrame, side: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Rows with the columns ``extra`` of a finished side table. Groups are of any size, so that no task may be given one whole:
    a small side goes to the rows, and a large one is repeated for each part of a group."""
    if not keys:
        return rows.join(F.broadcast(side.select(*extra)), F.lit(True))
    if side.limit(SMALL + 1).count() <= SMALL:
        d, s, on = rows, F.broadcast(side), keys
    else:
        d, s = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
        on = [*keys, "_part"]
    return d.alias("d").join(s.alias("s"), same_keys("d", "s", on)).select(*[f"d.{c}" for c in rows.columns], *[f"s.{c}" for c in extra])


def _edge_counts(rows: DataFrame, edges: DataFrame, keys: list[str], many: int, weight: Column) -> DataFrame:
    """Per key the edges with the weight of the rows below each (``lt``) and up to it (``le``): one pass, no sort."""
    joined = _beside(rows, edges, keys, ["_edges"])
    sums = []
    for j in range(many):
        edge = F.get("_edges", F.lit(j))
        sums += [F.sum(F.when(F.col("_v") < edge, weight).otherwise(0)).alias(f"_lt{j}"), F.sum(F.when(F.col("_v") <= edge, weight).otherwise(0)).alias(f"_le{j}")]
    counted = joined.groupBy(*keys).agg(F.first("_edges").alias("_edges"), *sums)
    cells = [F.struct(F.get("_edges", F.lit(j)).alias("e"), F.col(f"_lt{j}").alias("lt"), F.col(f"_le{j}").alias("le")) for j in range(many)]
    return counted.select(*keys, F.array(*cells).alias("_cells"))


def _narrowed(targets: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with the value of the edge that holds their rank, else the open interval between two edges, and the rank and rows in it."""
    out = _with(targets, cells, keys, ["_cells"])
    rank = F.col("_rank")
    hit = F.filter("_cells", lambda c: (c["lt"] <= rank) & (rank < c["le"]))
    under = F.array_max(F.transform(F.filter("_cells", lambda c: c["le"] <= rank), lambda c: F.struct(c["e"].alias("e"), c["le"].alias("le"))))
    over = F.array_min(F.transform(F.filter("_cells", lambda c: c["lt"] > rank), lambda c: F.struct(c["e"].alias("e"), c["lt"].alias("lt"))))
    out = out.withColumns({"_hit": F.get(hit, F.lit(0))["e"], "_under": under, "_over": over})
    low, size = F.coalesce(F.col("_under.le"), F.lit(0)), F.coalesce(F.col("_over.lt"), F.col("_size"))
    return out.select(*targets.drop("_rank", "_size", "_lo", "_hi", "_found").columns, (rank - low).alias("_rank"), (size - low).alias("_size"),
                      F.coalesce("_under.e", "_lo").alias("_lo"), F.coalesce("_over.e", "_hi").alias("_hi"), F.col("_hit").alias("_found"))


def _inside(rows: DataFrame, targets: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Distinct values with their counts inside each open target's interval."""
    names = [k for k in keys if k not in on]
    wanted = targets.filter("_found is null").select(*keys, "_lo", "_hi")
    joined = _beside(rows, wanted, on, [*names, "_lo", "_hi"])
    kept = joined.filter((F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))
    return cut_lineage(kept.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")))


def exact_percentiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float],
                      accuracy: int = 10000, most: int = 4096, parts: int = 16) -> DataFrame:
    """Exact linearly interpolated percentiles of groups of any size.

    A percentile lies between two ranks. Each rank is selected by counting: a sketch names edges near it, one pass counts
    the rows below and up to each edge, and only rows strictly between the two nearest edges stay. Rounds follow until no rank has
    more than ``most`` rows left, so that nothing larger is ever sorted. NULL values do not count. One row per group and probability: ``p``, ``n``, ``percentile``.
    """
    slack = 3.0 / accuracy
    near = sorted({q for p in probabilities for q in (max(0.0, p - slack), min(1.0, p + slack))})
    keys = [*groups, "p", "_side"]
    data = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    sketch = cut_lineage(data.groupBy(*groups).agg(F.count("_v").alias("n"), F.percentile_approx("_v", near, accuracy).alias("_edges")).filter("n > 0"))
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(side).alias("_side")) for p in probabilities for side in (0, 1)])).alias("_t")
    targets = sketch.select(*groups, "n", sides).select(*groups, "n", "_t.p", "_t._side")
    position = F.col("p") * (F.col("n") - 1)
    targets = targets.withColumns({"_rank": F.when(F.col("_side") == 0, F.floor(position)).otherwise(F.ceil(position)).cast("bigint"), "_size": F.col("n"),
                                   "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    cells = _edge_counts(data, sketch, groups, len(near), F.lit(1))
    targets = cut_lineage(_narrowed(targets, cells, groups))
    rows = _inside(data.withColumn("_c", F.lit(1)), targets, groups, keys)
    done = targets.filter("_found is not null")
    while not targets.filter(F.col("_found").isNull() & (F.col("_size") > most)).isEmpty():
        fractions = [k / parts for k in range(1, parts)]
        edges = cut_lineage(rows.groupBy(*keys).agg(F.percentile_approx("_v", fractions, accuracy).alias("_edges")))
        cells = _edge_counts(rows, edges, keys, len(fractions), F.col("_c"))
        targets = cut_lineage(_narrowed(targets.filter("_found is null"), cells, keys))
        rows = _inside(rows, targets, keys, keys)
        done = done.unionByName(targets.filter("_found is not null"))
    left = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_list"))
    open_ = _with(targets.filter("_found is null").drop("_found"), left, keys, ["_list"])
    start = F.struct(F.col("_rank").alias("left"), F.lit(None).cast("double").alias("v"))
    pick = F.aggregate("_list", start, lambda a, x: F.struct((a["left"] - x["_c"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["_c"]), x["_v"]).otherwise(a["v"]).alias("v")))
    values = open_.withColumn("_found", pick["v"]).select(*keys, "n", "_found").unionByName(done.select(*keys, "n", "_found"))
    ends = values.groupBy(*groups, "p", "n").agg(F.max(F.when(F.col("_side") == 0, F.col("_found"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_found"))).alias("_z"))
    share = position - F.floor(position)
    return ends.select(*groups, "p", "n", (F.col("_a") + (F.col("_z") - F.col("_a")) * share).alias("percentile"))


def running(df: DataFrame, groups: list[str], order: list[Column], value: str, name: str, bucket: Column,
            how: str = "sum", inclusive: bool = False) -> DataFrame:
    """Running ``sum`` or ``max`` in order, before each row or including it, for groups of any size."""
    fold = {"sum": F.sum, "max": F.max}[how]
    keyed = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    starts = keyed.groupBy(*keys).agg(fold(value).alias("_size")).withColumn(
        "_start", fold("_size").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(*_BEFORE)))
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    local = keyed.withColumn("_local", fold(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    joined = local.alias("l").join(starts.alias("s"), same_keys("l", "s", keys))
    here, before = F.col("l._local"), F.col("s._start")
    zero = F.lit(0)
    both = F.coalesce(here, zero) + F.coalesce(before, zero) if how == "sum" else F.greatest(here, before)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], both.alias(name))


def running_before(df: DataFrame, groups: list[str], order: list[Column], weight: str, name: str,
                   bucket: Column) -> DataFrame:
    """Sum of ``weight`` over the rows before each one."""
    return running(df, groups, order, weight, name, bucket)
