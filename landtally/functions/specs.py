"""Label specifications: units and bounds per label, extended but never redefined by the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Built-in labels, their units and closed bounds.
BUILT_IN = {
    "soil_moisture": dict(units="m3 m-3", low=0.0, high=1.0),
    "et": dict(units="mm day-1", low=0.0, high=50.0),
    "water": dict(units="1", low=0.0, high=1.0),
    "snow_ice": dict(units="1", low=0.0, high=1.0),
    "land": dict(units="1", low=0.0, high=1.0),
}


def resolve(extra: dict[str, dict]) -> dict[str, dict]:
    """Built-in specs plus the user's; redefinition and malformed bounds are refused."""
    clash = sorted(set(extra) & set(BUILT_IN))
    if clash:
        raise ValueError(f"built-in labels cannot be redefined: {clash}")
    for name, s in extra.items():
        if not {"units", "low", "high"} <= set(s) or not s["low"] < s["high"]:
            raise ValueError(f"malformed label spec: {name}")
    return {**BUILT_IN, **extra}


def spec_table(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    """One row per label: a fixed, small dimension."""
    rows = [(n, s["units"], float(s["low"]), float(s["high"])) for n, s in specs.items()]
    return spark.createDataFrame(rows, "label string, units string, low double, high double")
