"""Area weights of a tile's output pixels in the coarse cells that lie inside it.

Pixels are squares of the tile's own grid, cells are boxes of another projection. Both become polygons in an equal-area plane
around the tile, so neither is aligned to its axes. Pixels well inside a cell count whole; those at its rim are clipped,
all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Names instead of the module: what runs in tasks must not take the module's own UDFs along.
from landtally.functions.geo import _E2, WGS84_A, Arrays, inverse_mercator
from landtally.session import spread

# Fixed value: radius of the authalic sphere that is also the sphere of the sinusoidal land grid.
SPHERE_M = 6371007.181
#: Straight pieces of each side of a cell, share of a cell that may leave the tile by rounding, and vertices clipped at once.
PIECES, ROUNDING, AT_ONCE = 16, 1e-7, 1 << 20


def cell_ring(left: Column, bottom: Column, width: Column, height: Column, sinusoidal: bool = False) -> Column:
    """Vertices (lon, lat) of a box of a coarse grid, against the clock from its lower left; sides in ``PIECES``.

    The box is in degrees, or with ``sinusoidal`` in metres of the sinusoidal land grid.
    """
    k = F.sequence(F.lit(0), F.lit(4 * PIECES - 1))

    def vertex(i: Column) -> Column:
        side, step = F.floor(i / PIECES), F.pmod(i, F.lit(PIECES)) / F.lit(float(PIECES))
        along = F.when(side == 0, step).when(side == 1, 1.0).when(side == 2, 1 - step).otherwise(0.0)
        up = F.when(side == 0, 0.0).when(side == 1, step).when(side == 2, 1.0).otherwise(1 - step)
        x, y = left + width * along, bottom + height * up
        if sinusoidal:
            phi = y / SPHERE_M
            x, y = F.degrees(x / (F.cos(phi) * SPHERE_M)), F.degrees(phi)
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(k, vertex)


def equal_area(lon, lat, lon0: float, lat0: float) -> np.ndarray:
    """Lambert azimuthal equal-area metres around (lon0, lat0), last axis x and y. On the ellipsoid's authalic latitudes."""
    e2 = _E2
    e = np.sqrt(e2)

    def authalic(phi):
        q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
        return np.arcsin(np.clip(q(np.sin(phi)) / q(1.0), -1, 1))

    phi0, beta, beta0 = np.radians(lat0), authalic(np.radians(lat)), authalic(np.radians(lat0))
    q_pole = 1 + (1 - e2) * np.arctanh(e) / e
    radius = WGS84_A * np.sqrt(q_pole / 2)
    # The scale along the parallel of the centre is kept true.
    stretch = WGS84_A * np.cos(phi0) / np.sqrt(1 - e2 * np.sin(phi0) ** 2) / (radius * np.cos(beta0))
    turn = np.radians((np.asarray(lon) - lon0 + 180) % 360 - 180)
    k = radius * np.sqrt(2 / (1 + np.sin(beta0) * np.sin(beta) + np.cos(beta0) * np.cos(beta) * np.cos(turn)))
    x, y = k * np.cos(beta) * np.sin(turn), k * (np.cos(beta0) * np.sin(beta) - np.sin(beta0) * np.cos(beta) * np.cos(turn))
    return np.stack([x * stretch, y / stretch], axis=-1)


def ring_area(rings: np.ndarray) -> np.ndarray:
    """Areas of rings (…, vertex, 2), positive against the clock."""
    x, y = rings[..., 0], rings[..., 1]
    return (x * np.roll(y, -1, -1) - y * np.roll(x, -1, -1)).sum(-1) / 2


def _cross(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def clipped_areas(ring: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Area of a ring inside each of many convex quads against the clock; all are clipped together, one side after the other."""
    n = len(quads)
    poly, count = np.broadcast_to(ring, (n, *ring.shape)), np.full(n, len(ring))
    for k in range(4):
        a, b = quads[:, None, k], quads[:, None, (k + 1) % 4]
        at = np.arange(poly.shape[1])
        valid = at < count[:, None]
        following = np.take_along_axis(poly, np.where(at + 1 < count[:, None], at + 1, 0)[..., None], 1)
        here, there = _cross(a, b, poly), _cross(a, b, following)
        gap = here - there
        crossing = valid & (here * there < 0)
        share = np.where(crossing, here / np.where(gap == 0, 1, gap), 0)[..., None]
        points = np.stack([poly, poly + (following - poly) * share], axis=2).reshape(n, -1, 2)
        kept = np.stack([valid & (here >= 0), crossing], axis=2).reshape(n, -1)
        count = kept.sum(1)
        width = max(1, count.max(initial=0))
        order = np.argsort(~kept, axis=1, kind="stable")[:, :width]
        poly = np.take_along_axis(points, order[..., None], 1)
    # Places past the end repeat the first vertex and add nothing.
    at = np.arange(poly.shape[1])
    poly = np.where((at < count[:, None])[..., None], poly, poly[:, :1])
    return np.where(count > 2, ring_area(poly), 0.0)


def overlap_areas(ring: np.ndarray, lattice: np.ndarray) -> np.ndarray:
    """(row, column) areas of a ring inside the pixels between the points of a lattice whose rows run from north to south."""
    top, bottom = lattice[:-1], lattice[1:]
    quads = np.stack([bottom[:, :-1], bottom[:, 1:], top[:, 1:], top[:, :-1]], axis=2)
    out = np.zeros(quads.shape[:2])
    low, high = ring.min(0), ring.max(0)
    near = ((quads.max(2) > low) & (quads.min(2) < high)).all(-1)
    ends = np.roll(ring, -1, 0)
    inside = np.ones(lattice.shape[:2], bool)
    for a, b in zip(ring, ends):
        inside &= _cross(a, b, lattice) >= 0
    whole = near & inside[1:, :-1] & inside[1:, 1:] & inside[:-1, 1:] & inside[:-1, :-1]
    out[whole] = ring_area(quads[whole])
    rows, cols = np.nonzero(near & ~whole)
    step = max(1, AT_ONCE // (4 * len(ring)))
    for at in range(0, len(rows), step):
        part = rows[at:at + step], cols[at:at + step]
        out[part] = clipped_areas(ring, quads[part])
    return out


def _lattice(r, size: int, pixel_m: float) -> np.ndarray:
    """Pixel corners of a tile in its equal-area plane, from its upper left."""
    x, y = np.meshgrid(r.left_m + np.arange(size + 1) * pixel_m, r.top_m - np.arange(size + 1) * pixel_m)
    lon, lat = inverse_mercator(x, y, r.epsg % 100, float(r.epsg // 100 == 327), Arrays)
    return equal_area(lon, lat, r.lon, r.lat)


def _support(size: int, pixel_m: float, fine: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            parts = {k: [] for k in ("sample_id", "cell", "out_row", "out_col", "weight", "centre_row", "centre_col")}
            for r in pdf.itertuples(index=False):
                key = (r.left_m, r.top_m, r.epsg, r.lon, r.lat)
                if key not in lattices:
                    lattices = {**dict(list(lattices.items())[-63:]), key: _lattice(r, size, pixel_m)}
                lattice = lattices[key]
                ring = equal_area(np.array([v["lon"] for v in r.ring]), np.array([v["lat"] for v in r.ring]), r.lon, r.lat)
                outline = np.concatenate([lattice[-1, :-1], lattice[:0:-1, -1], lattice[0, :0:-1], lattice[:-1, 0]])
                # A vertex far outside settles it before any clipping.
                if (_cross(outline, np.roll(outline, -1, 0), ring[:, None]) < -pixel_m).any():
                    continue
                areas, whole = overlap_areas(ring, lattice), ring_area(ring)
                if whole <= 0 or areas.sum() < whole * (1 - ROUNDING):
                    continue
                # The middle of the cell in pixels: the tile is flat to a fraction of a pixel.
                axes = np.stack([lattice[0, -1] - lattice[0, 0], lattice[-1, 0] - lattice[0, 0]], 1)
                across, down = np.linalg.solve(axes, (ring[0] + ring[len(ring) // 2]) / 2 - lattice[0, 0]) * size * fine
                rows, cols = np.nonzero(areas > 0)
                for k, v in zip(parts, (r.sample_id, r.cell, rows, cols, areas[rows, cols] / areas.sum(), int(np.floor(down)), int(np.floor(across)))):
                    parts[k].append(v if np.ndim(v) else [v] * len(rows))
            if parts["cell"]:
                yield pd.DataFrame({k: np.concatenate([np.asarray(x) for x in v]) for k, v in parts.items()})
    return run


def native_support(tiles: DataFrame, cells: DataFrame, size: int = 40, pixel_m: float = 30.0, fine: int = 3) -> DataFrame:
    """Area weights of output pixels in each complete native cell of a tile; cells that leave the tile are dropped.

    ``tiles``: sample_id, lon, lat, epsg (a UTM zone), left_m and top_m of its upper left corner. ``cells``: sample_id, cell and ``ring`` as
    :func:`cell_ring` makes it. Rows count from the north and columns from the west, as in the tile's images;
    ``centre_row`` and ``centre_col`` name the image pixel, ``fine`` to an output pixel, in which the cell is sampled. Each cell is independent.
    """
    joined = cells.join(tiles, "sample_id").select("sample_id", "cell", "ring", "lon", "lat", "epsg", "left_m", "top_m")
    return spread(joined, "sample_id", "cell").mapInPandas(
        _support(size, pixel_m, fine), "sample_id string, cell bigint, out_row int, out_col int, weight double, centre_row int, centre_col int")


def native_targets(support: DataFrame, values: DataFrame, keys: tuple[str, str] = ("sample_id", "cell")) -> DataFrame:
    """Cells whose sampled image pixel is valid: keys, ``value``, and the weights as (out_row, out_col, weight) rows.

    ``values``: sample_id, row, col (of the image), value, valid.
    """
    spot = values.filter("valid").select("sample_id", F.col("row").alias("centre_row"), F.col("col").alias("centre_col"), "value")
    return support.join(spot, ["sample_id", "centre_row", "centre_col"]).select(*keys, "out_row", "out_col", "weight", "value")
