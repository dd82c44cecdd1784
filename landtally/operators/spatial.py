"""Spatial joins by cell, components of linked supports, native-cell operators and window plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from landtally.functions import geo
from landtally.operators.ordered import same_keys
from landtally.session import cut_lineage, spread


def hash_cells(df: DataFrame, lon: str, lat: str, cell_m: float, prefix: str = "c") -> DataFrame:
    """Three integer cell numbers of a point on the pruning sphere."""
    for name, v in zip("xyz", geo.sphere_xyz(F.col(lon), F.col(lat))):
        df = df.withColumn(f"{prefix}{name}", F.floor(v / cell_m).cast("bigint"))
    return df


def circles_overlap(left: DataFrame, right: DataFrame, cell_m: float = 20000.0, left_id: str = "left_id",
                    right_id: str = "right_id") -> DataFrame:
    """Pairs of circles (lon, lat, radius_m) whose geodesic distance is at most r1 + r2.

    Small circles on the right are grouped by size class, so one wide circle does not widen the
    search around all the narrow ones. Cells prune, a great-circle bound prunes again, and only
    survivors are measured on the ellipsoid.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("radius_m"), F.lit(1.0)) / cell_m)))
    r = hash_sized(right.withColumn("_size", size.cast("int")), cell_m)
    widest = r.agg(F.coalesce(F.max("_size"), F.lit(0))).scalar()
    l = left.withColumn("_size", F.explode(F.sequence(F.lit(0), widest)))
    width = F.lit(cell_m) * F.pow(F.lit(2.0), F.col("_size"))
    for name, v in zip("xyz", geo.sphere_xyz(F.col("lon"), F.col("lat"))):
        reach = F.col("radius_m") + width
        l = l.withColumn(f"c{name}", F.explode(F.sequence(
            F.floor((v - reach) / width).cast("bigint"), F.floor((v + reach) / width).cast("bigint"))))
    pair = l.alias("l").join(r.alias("r"), ["_size", "cx", "cy", "cz"])
    pair = pair.select(
        F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id),
        F.col("l.lon").alias("_lon1"), F.col("l.lat").alias("_lat1"), F.col("r.lon").alias("_lon2"), F.col("r.lat").alias("_lat2"),
        (F.col("l.radius_m") + F.col("r.radius_m")).alias("_limit"))
    bound = geo.haversine_m(F.col("_lon1"), F.col("_lat1"), F.col("_lon2"), F.col("_lat2"))
    near = pair.filter(bound <= F.col("_limit"))
    near = near.withColumn("distance_m", geo.geodesic_m("_lon1", "_lat1", "_lon2", "_lat2"))
    return near.filter(F.col("distance_m") <= F.col("_limit")).select(left_id, right_id, "distance_m")


def hash_sized(df: DataFrame, cell_m: float) -> DataFrame:
    width = F.lit(cell_m) * F.pow(F.lit(2.0), F.col("_size"))
    for name, v in zip("xyz", geo.sphere_xyz(F.col("lon"), F.col("lat"))):
        df = df.withColumn(f"c{name}", F.floor(v / width).cast("bigint"))
    return df


def distance_links(points: DataFrame, key: str, reach_m: float) -> DataFrame:
    """Edges that connect every pair of points within ``reach_m``, directly or through other edges.

    Points at one coordinate link to their smallest key. Cells are small enough that all their
    points are mutually in reach, so a cell is a star, not all pairs. Between two cells one
    edge is enough: the smallest pair in reach is kept by a partial aggregate, per cell pair.
    """
    # Cell diagonal on the pruning sphere stays below the reach on the ellipsoid.
    cell = reach_m / (math.sqrt(3) * 1.02)
    spots = points.groupBy("lon", "lat").agg(F.min(key).alias("_spot"))
    same = points.join(spots, ["lon", "lat"]).filter(F.col(key) != F.col("_spot")).select(
        F.col(key).alias("a"), F.col("_spot").alias("b"))
    cells = hash_cells(spots, "lon", "lat", cell)
    heads = cells.groupBy("cx", "cy", "cz").agg(F.min("_spot").alias("_head"))
    star = cells.join(heads, ["cx", "cy", "cz"]).filter(F.col("_spot") != F.col("_head")).select(
        F.col("_spot").alias("a"), F.col("_head").alias("b"))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "ijk")]) for s in steps])
    moved = cells.withColumn("_o", F.explode(around)).select(
        "_spot", "lon", "lat", *[F.col(f"c{n}").alias(f"h{n}") for n in "xyz"],
        *[(F.col(f"c{n}") + F.col(f"_o.{o}")).alias(f"c{n}") for n, o in zip("xyz", "ijk")])
    pair = moved.alias("l").join(cells.alias("r"), ["cx", "cy", "cz"])
    args = [F.col("l.lon"), F.col("l.lat"), F.col("r.lon"), F.col("r.lat")]
    near = pair.filter(geo.haversine_m(*args) <= reach_m).select(
        "hx", "hy", "hz", "cx", "cy", "cz", F.col("l._spot").alias("_a"), F.col("r._spot").alias("_b"), geo.geodesic_m(*args).alias("_m"))
    bridge = near.filter(F.col("_m") <= reach_m).groupBy("hx", "hy", "hz", "cx", "cy", "cz").agg(
        F.min(F.struct("_a", "_b")).alias("_e")).select(F.col("_e._a").alias("a"), F.col("_e._b").alias("b"))
    return same.unionByName(star).unionByName(bridge)


def identity_links(df: DataFrame, key: str, identity: str) -> DataFrame:
    """Members of one identity link to its smallest key: a star, never all pairs."""
    heads = df.groupBy(identity).agg(F.min(key).alias("b"))
    return df.join(heads, identity).filter(F.col(key) != F.col("b")).select(F.col(key).alias("a"), "b")


def components(nodes: DataFrame, edges: DataFrame, key: str, name: str = "component") -> DataFrame:
    """Smallest key reachable from each node.

    Labels fall to the neighbourhood minimum and then jump to the label's own label, so rounds grow
    with the logarithm of the longest chain. Each round is checkpointed; it ends when nothing changes.
    """
    links = edges.select("a", "b").filter("a <> b")
    links = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        seen = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("_low"))
        low = labels.join(seen, labels.node == seen.a, "left").select(
            "node", "label", F.least("label", F.coalesce("_low", "label")).alias("_low"))
        jump = low.select(F.col("node").alias("_node"), F.col("_low").alias("_jump"))
        new = low.join(jump, F.col("_low") == F.col("_node")).select(
            "node", F.col("label").alias("_old"), F.least("_low", "_jump").alias("label"))
        new = cut_lineage(new)
        labels = new.select("node", "label")
        if new.filter("_old <> label").isEmpty():
            return labels.select(F.col("node").alias(key), F.col("label").alias(name))


def tile_circle(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Circle enclosing the 1200 m tile whose centre output cell holds the point: farthest corner plus 2 m.

    The tile lies in the point's own grid, a polar one beyond 84 N and 80 S.
    """
    out = geo.with_projection(df, lon, lat, "_x", "_y").withColumn("_z", geo.grid_epsg(F.col(lon), F.col(lat)))
    far = []
    for i, (dx, dy) in enumerate(((-615, 615), (585, 615), (585, -585), (-615, -585))):
        clon, clat = geo.inverse_projection(F.col("_x") + dx, F.col("_y") + dy, F.col("_z"))
        out = out.withColumn(f"_lon{i}", clon).withColumn(f"_lat{i}", clat)
        far.append(geo.geodesic_m(F.col(lon), F.col(lat), F.col(f"_lon{i}"), F.col(f"_lat{i}")))
    out = out.withColumn("radius_m", F.greatest(*far) + 2)
    return out.select(*df.columns, "radius_m")


def coarse_circle(df: DataFrame, cell_deg: float, floor_m: float = 16500.0) -> DataFrame:
    """Centre and enclosing circle of a geographic grid cell (``col``, ``row``) with a minimum support radius."""
    lon0, lat1 = F.col("col") * cell_deg - 180, F.lit(85.0) - F.col("row") * cell_deg
    out = df.withColumn("lon", lon0 + cell_deg / 2).withColumn("lat", lat1 - cell_deg / 2)
    corner = [geo.geodesic_m(F.col("lon"), F.col("lat"), lon0 + dx, lat1 - dy) for dx in (0.0, cell_deg) for dy in (0.0, cell_deg)]
    return out.withColumn("radius_m", F.greatest(F.lit(floor_m), *corner) + 2)


def native_operator(weights: DataFrame, cell_of: dict[str, Column], keys: list[str]) -> DataFrame:
    """30 m weights assigned to the native cell under each pixel centre and summed per cell."""
    out = weights
    for name, c in cell_of.items():
        out = out.withColumn(name, c)
    return out.groupBy(*keys, *cell_of).agg(F.sum("weight").alias("weight"))


def reduce_cells(df: DataFrame, keys: list[str], weight: str = "weight", value: str = "et", purity: str = "purity",
                 limit: float = 0.95, atol: float = 1e-5) -> DataFrame:
    """Weighted value only with the complete support; otherwise NULL and a reason, never renormalised."""
    ok_value = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0)
    out = df.groupBy(*keys).agg(
        F.sum(weight).alias("_w"), F.min(F.when(F.coalesce(F.col(purity), F.lit(0.0)) > limit, 1).otherwise(0)).alias("_pure"),
        F.min(F.when(ok_value, 1).otherwise(0)).alias("_ok"), F.sum(F.col(weight) * F.col(value)).alias("_v"))
    reason = (F.when(F.abs(F.col("_w") - 1) > atol, "incomplete_weight").when(F.col("_pure") == 0, "impure_cell")
              .when(F.col("_ok") == 0, "missing_or_negative_value"))
    return out.select(*keys, F.when(reason.isNull(), F.col("_v")).alias("value"), reason.alias("reason"))


def anchored_positions(size: Column, window: int, stride: int) -> Column:
    """Start offsets along one axis; the last is anchored to the edge."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), size - window).cast("int"), F.lit(stride))
    return F.array_distinct(F.array_append(steps, F.greatest(F.lit(0), size - window).cast("int")))


def window_grid(areas: DataFrame, key: str, stride: float, core: float) -> DataFrame:
    """Windows on the global stride lattice whose core meets the area's bounds (x0, y0, x1, y1)."""
    axis = lambda a, b: F.sequence(F.floor((F.col(a) - core) / stride).cast("bigint") + 1, F.ceil(F.col(b) / stride).cast("bigint") - 1)
    out = areas.withColumn("ix", F.explode(axis("x0", "x1"))).withColumn("iy", F.explode(axis("y0", "y1")))
    out = out.withColumn("wx", F.col("ix") * stride).withColumn("wy", F.col("iy") * stride)
    meets = (F.col("wx") < F.col("x1")) & (F.col("wx") + core > F.col("x0")) & (F.col("wy") < F.col("y1")) & (F.col("wy") + core > F.col("y0"))
    return out.filter(meets).select(key, "ix", "iy", "wx", "wy")


#: Members of a class of equal boxes that travel together.
MEMBERS = 512


def boxes_intersect(left: DataFrame, right: DataFrame, cell: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of axis-aligned boxes that intersect (touching edges do not count).

    Equal boxes are one class, and only classes are compared: spread over grid cells, where a pair is reported by the cell
    that holds the lower-left corner of the intersection, so no distinct is needed. The pairs of the members are then
    listed from runs of about ``MEMBERS`` ids, dealt over all tasks.
    """
    corners = ["x0", "y0", "x1", "y1"]

    def classes(df: DataFrame, key: str, p: str) -> tuple[DataFrame, DataFrame]:
        found = df.groupBy(*corners).agg(F.min(key).alias(f"_{p}"), F.count(F.lit(1)).alias("_n"))
        own = df.alias("d").join(found.alias("f"), same_keys("d", "f", corners)).select(F.col(f"d.{key}").alias("_id"), f"f._{p}", "f._n")
        run = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / MEMBERS))
        return found, own.groupBy(f"_{p}", run.alias(f"_{p}run")).agg(F.collect_list("_id").alias(f"_{p}ids"))

    def over_cells(found: DataFrame, p: str) -> DataFrame:
        cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("bigint"), F.floor(F.col(b) / cell).cast("bigint")))
        out = found.select(f"_{p}", *[F.col(c).alias(f"{p}{c}") for c in corners])
        return spread(out.withColumn("_cx", cover(f"{p}x0", f"{p}x1")).withColumn("_cy", cover(f"{p}y0", f"{p}y1")), "_cx", "_cy")
    (lf, lm), (rf, rm) = classes(left, left_id, "l"), classes(right, right_id, "r")
    j = over_cells(lf, "l").join(over_cells(rf, "r"), ["_cx", "_cy"])
    x0, y0 = F.greatest("lx0", "rx0"), F.greatest("ly0", "ry0")
    meets = (x0 < F.least("lx1", "rx1")) & (y0 < F.least("ly1", "ry1"))
    home = (F.floor(x0 / cell) == F.col("_cx")) & (F.floor(y0 / cell) == F.col("_cy"))
    runs = j.filter(meets & home).select("_l", "_r").join(lm, "_l").join(rm, "_r")
    runs = spread(runs, "_l", "_lrun", "_r", "_rrun").select("_rids", F.explode("_lids").alias(left_id))
    return runs.select(left_id, F.explode("_rids").alias(right_id))


def common_cells(boxes: DataFrame, cell: float, sensor: str, sensors: int, keys: list[str] = ()) -> DataFrame:
    """Grid cells lying fully inside some box of every one of ``sensors`` sensors."""
    inside = lambda a, b: F.explode(F.sequence(F.ceil(F.col(a) / cell).cast("bigint"), F.floor(F.col(b) / cell).cast("bigint") - 1))
    fits = (F.ceil(F.col("x0") / cell) <= F.floor(F.col("x1") / cell) - 1) & (F.ceil(F.col("y0") / cell) <= F.floor(F.col("y1") / cell) - 1)
    cells = boxes.filter(fits).withColumn("cx", inside("x0", "x1")).withColumn("cy", inside("y0", "y1"))
    found = cells.groupBy(*keys, "cx", "cy").agg(F.countDistinct(sensor).alias("_n"))
    return found.filter(F.col("_n") == sensors).drop("_n")


def cover_point_windows(points: DataFrame, owner_m: float = 900.0, window_m: float = 1200.0, pixel_m: float = 30.0,
                        x: str = "x", y: str = "y", zone: str = "epsg") -> DataFrame:
    """Each point belongs to one 900 m ownership cell inside a 1200 m window; row and column at 30 m."""
    out = points.withColumn("own_x", F.floor(F.col(x) / owner_m).cast("bigint")).withColumn("own_y", F.floor(F.col(y) / owner_m).cast("bigint"))
    pad = (window_m - owner_m) / 2
    left, top = F.col("own_x") * owner_m - pad, F.col("own_y") * owner_m + owner_m + pad
    return out.withColumn("left_m", left).withColumn("top_m", top).withColumn(
        "col", F.floor((F.col(x) - left) / pixel_m).cast("int")).withColumn("row", F.floor((top - F.col(y)) / pixel_m).cast("int"))
