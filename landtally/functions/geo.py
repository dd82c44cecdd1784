"""Projections and distances in closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# The WGS84 ellipsoid and the universal transverse Mercator scale and false easting.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EAST = 500000.0
# Below the least curvature radius of WGS84, so pruning on this sphere can lose no true neighbour.
SAFE_RADIUS = 6300000.0

_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)
_N = WGS84_F / (2 - WGS84_F)
_MEAN_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series of fourth order in the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def grid_epsg(lon: Column, lat: Column) -> Column:
    """UTM by hemisphere; polar stereographic beyond 84 N and 80 S."""
    zone = utm_zone(lon)
    return (F.when(lat >= 84, F.lit(3413)).when(lat < -80, F.lit(3031))
            .when(lat >= 0, zone + 32600).otherwise(zone + 32700))


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def with_mercator(df: DataFrame, lon: Column, lat: Column, x: str, y: str) -> DataFrame:
    """Easting and northing in the point's own UTM zone.

    The series is built over intermediate columns, so each power of it is computed once and the
    generated code stays small.
    """
    sin = F.sin(F.radians(lat))
    out = df.withColumn("_t", F.sinh(_atanh(sin) - F.lit(_E) * _atanh(F.lit(_E) * sin))).withColumn(
        "_d", F.radians(lon - (utm_zone(lon) * 6 - 183)))
    out = out.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_d"))).withColumn(
        "_eta", _atanh(F.sin("_d") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = UTM_SCALE * _MEAN_RADIUS
    return out.withColumn(x, east * k + UTM_EAST).withColumn(
        y, north * k + F.when(lat < 0, 1e7).otherwise(0.0)).drop("_t", "_d", "_xi", "_eta")


def with_grid_factors(df: DataFrame, lon: str = "lon", lat: str = "lat", convergence: str = "convergence_deg", scale: str = "grid_scale") -> DataFrame:
    """Meridian convergence (bearing of grid north, clockwise) and point scale of a place in its own grid, as :func:`grid_epsg` names it.

    The derivative of the Krueger series gives both for the Mercator zones. In the polar grids the meridians are straight
    and the scale is the circle's length over the parallel's.
    """
    a, b = F.col(lon), F.col(lat)
    polar = (b >= 84) | (b < -80)
    phi = F.radians(F.when(~polar, b))
    out = df.withColumns({"_sin": F.sin(phi), "_d": F.radians(a - (utm_zone(a) * 6 - 183))})
    out = out.withColumn("_t", F.sinh(_atanh(F.col("_sin")) - F.lit(_E) * _atanh(F.lit(_E) * F.col("_sin"))))
    t, d = F.col("_t"), F.col("_d")
    out = out.withColumns({"_xi": F.atan2(t, F.cos(d)), "_eta": _atanh(F.sin(d) / F.sqrt(1 + t * t))})
    p, q = F.lit(1.0), F.lit(0.0)
    for j, c in enumerate(_ALPHA, 1):
        p = p + F.lit(2 * j * c) * F.cos(F.col("_xi") * (2 * j)) * F.cosh(F.col("_eta") * (2 * j))
        q = q + F.lit(2 * j * c) * F.sin(F.col("_xi") * (2 * j)) * F.sinh(F.col("_eta") * (2 * j))
    out = out.withColumns({"_p": p, "_q": q})
    turn = F.atan(t / F.sqrt(1 + t * t) * F.tan(d)) + F.atan2(F.col("_q"), F.col("_p"))
    stretch = (F.sqrt(1 - F.lit(_E2) * F.col("_sin") * F.col("_sin")) / F.cos(phi) / F.sqrt(t * t + F.cos(d) * F.cos(d))
               * F.sqrt(F.col("_p") * F.col("_p") + F.col("_q") * F.col("_q")) * (UTM_SCALE * _MEAN_RADIUS / WGS84_A))
    x, y = polar_stereographic(a, F.when(polar, b))
    pole_sin = F.sin(F.radians(b))
    parallel = F.lit(WGS84_A) * F.cos(F.radians(b)) / F.sqrt(1 - F.lit(_E2) * pole_sin * pole_sin)
    pole_turn = F.pmod(F.when(b >= 0, a + 45).otherwise(-a) + 180, F.lit(360.0)) - 180
    return out.withColumn(convergence, F.when(polar, pole_turn).otherwise(F.degrees(turn))).withColumn(
        scale, F.when(polar, F.sqrt(x * x + y * y) / parallel).otherwise(stretch)).drop("_sin", "_d", "_t", "_xi", "_eta", "_p", "_q")


# The inverse of the same series.
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
# Conformal to geodetic latitude.
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


class Arrays:
    """The functions of numpy under the names that columns have them by, for formulas that serve both."""

    sin, cos, sinh, cosh, sqrt, degrees, radians, asin, atan2 = (staticmethod(f) for f in (
        np.sin, np.cos, np.sinh, np.cosh, np.sqrt, np.degrees, np.radians, np.arcsin, np.arctan2))
    lit = staticmethod(lambda v: v)


def inverse_mercator(x, y, zone, south, m=F):
    """Longitude and latitude of a UTM position; columns, or arrays with ``m=Arrays``."""
    k = UTM_SCALE * _MEAN_RADIUS
    false_north = F.when(south, 1e7).otherwise(0.0) if m is F else south * 1e7
    xi0, eta0 = (y - false_north) / k, (x - UTM_EAST) / k
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - m.lit(b) * m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j))
        eta = eta - m.lit(b) * m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j))
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + m.lit(d) * m.sin(chi * (2 * j))
    return zone * 6 - 183 + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(phi)


# Latitude of true scale of the two polar grids.
_TRUE_SCALE = {True: 70.0, False: 71.0}


def _polar_radius(degrees: float) -> float:
    """Metres from the pole for a unit of the conformal half-angle tangent, with the scale true at a latitude."""
    s = math.sin(math.radians(degrees))
    t = math.tan(math.pi / 4 - math.radians(degrees) / 2) / ((1 - _E * s) / (1 + _E * s)) ** (_E / 2)
    return WGS84_A * math.cos(math.radians(degrees)) / math.sqrt(1 - _E2 * s * s) / t


def inverse_polar(x: Column, y: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position in the polar grid of the hemisphere."""
    radius = F.when(north, _polar_radius(_TRUE_SCALE[True])).otherwise(_polar_radius(_TRUE_SCALE[False]))
    chi = F.lit(math.pi / 2) - F.atan(F.sqrt(x * x + y * y) / radius) * 2
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    turn = F.degrees(F.atan2(x, F.when(north, -y).otherwise(y))) - F.when(north, 45.0).otherwise(0.0)
    return F.pmod(turn + 180, F.lit(360.0)) - 180, F.when(north, F.degrees(phi)).otherwise(-F.degrees(phi))


def inverse_projection(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position in the grid that :func:`grid_epsg` names."""
    polar = epsg.isin(3413, 3031)
    lon, lat = inverse_mercator(x, y, epsg % 100, epsg.between(32701, 32760))
    plon, plat = inverse_polar(x, y, epsg == 3413)
    return F.when(polar, plon).otherwise(lon), F.when(polar, plat).otherwise(lat)


def polar_stereographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 3413 in the north (70 N, 45 W) and 3031 in the south (71 S, 0)."""
    north = lat >= 0
    def t_of(phi):
        s = F.sin(phi)
        return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - F.lit(_E) * s) / (1 + F.lit(_E) * s), F.lit(_E / 2))
    rho = t_of(F.radians(F.abs(lat))) * F.when(north, _polar_radius(_TRUE_SCALE[True])).otherwise(_polar_radius(_TRUE_SCALE[False]))
    angle = F.radians(F.when(north, lon + 45).otherwise(lon))
    return rho * F.sin(angle), F.when(north, -rho * F.cos(angle)).otherwise(rho * F.cos(angle))


def with_projection(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """UTM position, or polar stereographic beyond 84 N and 80 S."""
    a, b = F.col(lon), F.col(lat)
    polar = (b >= 84) | (b < -80)
    px, py = polar_stereographic(a, F.when(polar, b))
    out = with_mercator(df.withColumn("_px", px).withColumn("_py", py), a, F.when(~polar, b), x, y)
    return out.withColumn(x, F.coalesce("_px", x)).withColumn(y, F.coalesce("_py", y)).drop("_px", "_py")


def snapped_corner(x: Column, y: Column) -> tuple[Column, Column]:
    """Upper-left corner of the 1200 m tile around a projected point, on the 30 m lattice."""
    return F.bround((x - 600) / 30) * 30, F.bround((y + 600) / 30) * 30


def centred_corner(x: Column, y: Column) -> tuple[Column, Column]:
    """Upper-left corner of the tile whose centre output cell holds the projected point."""
    return x - 615, y + 615


def sphere_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return (F.lit(SAFE_RADIUS) * F.cos(b) * F.cos(a), F.lit(SAFE_RADIUS) * F.cos(b) * F.sin(a),
            F.lit(SAFE_RADIUS) * F.sin(b))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = SAFE_RADIUS) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((p2 - p1) / 2), F.lit(2))
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def vincenty_m(lon1, lat1, lon2, lat2):
    """WGS84 inverse distance for arrays. Nearly antipodal points do not settle; callers prune long before."""
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    target = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = target.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam),
                             np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a < 1e-15, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = target + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            step = np.nanmax(np.abs(new - lam)) if len(new) else 0
            lam = new
            if step < 1e-13:
                break
        k = cos2_a * (a**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        shift = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1)
                 - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        return b * big_a * (sigma - shift)


@pandas_udf(T.DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Arrow-batched WGS84 geodesic distance in metres."""
    return pd.Series(vincenty_m(lon1, lat1, lon2, lat2))


def affine_cell(x: Column, y: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """Column and row of a point in an unrotated grid (a, 0, left, 0, e, top)."""
    a, _, left, _, e, top = transform
    return F.floor((x - F.lit(left)) / F.lit(a)).cast("bigint"), F.floor((y - F.lit(top)) / F.lit(e)).cast("bigint")
