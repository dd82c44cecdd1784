"""Named queries and, where SQL can say the same, their comparison text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landtally.plans.shapes import Duck, Tables, expand
from landtally.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use ``@shape`` and ``$table``."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(Tables(spark, sf_dir))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql, Duck())
        return fn
    return wrap


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison: the last bits of a sum depend on its order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def R(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def day_text(value: Column | str) -> Column:
    return F.date_format(F.col(value) if isinstance(value, str) else value, "yyyy-MM-dd")


def D(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def sql_span(day: str, lat: str, lon: str) -> tuple[str, str]:
    """Sunrise and sunset seconds of a UTC day as SQL, for comparison texts."""
    leap = f"CAST(dayofyear(make_date(year({day}), 12, 31)) AS DOUBLE)"
    g = f"(2 * pi() / {leap} * (dayofyear({day}) - 1))"
    eq = f"(229.18 * (0.000075 + 0.001868*cos({g}) - 0.032077*sin({g}) - 0.014615*cos(2*{g}) - 0.040849*sin(2*{g})))"
    dec = (f"(0.006918 - 0.399912*cos({g}) + 0.070257*sin({g}) - 0.006758*cos(2*{g}) + 0.000907*sin(2*{g})"
           f" - 0.002697*cos(3*{g}) + 0.00148*sin(3*{g}))")
    hc = f"((cos(radians(90.833)) - sin(radians({lat}))*sin({dec})) / greatest(1e-15, cos(radians({lat}))*cos({dec})))"
    half = f"(degrees(acos(greatest(-1.0, least(1.0, {hc})))) * 240)"
    mid = f"epoch(CAST({day} AS TIMESTAMP))"
    noon = f"({mid} + (720 - 4*({lon}) - {eq}) * 60)"
    left = f"CASE WHEN {hc} >= 1 THEN NULL WHEN {hc} <= -1 THEN {mid} ELSE {noon} - {half} END"
    right = f"CASE WHEN {hc} >= 1 THEN NULL WHEN {hc} <= -1 THEN {mid} + 86400 ELSE {noon} + {half} END"
    return left, right
