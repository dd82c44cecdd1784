"""Key/value station metadata: attributes accepted only when unambiguous, and dated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Attributes of a site and the closed range a number must lie in.
SITE_RANGES = {"LOCATION_LAT": (-90.0, 90.0), "LOCATION_LONG": (-180.0, 180.0), "UTC_OFFSET": (-12.0, 14.0)}
SITE_TEXT = ("IGBP",)


def site_attributes(rows: DataFrame, site: list[str], variable: str = "VARIABLE", value: str = "DATAVALUE") -> DataFrame:
    """One row per site; an attribute needs exactly one distinct valid value, else it is NULL with an issue."""
    names = [*SITE_RANGES, *SITE_TEXT]
    number = F.col(value).try_cast("double")
    legal = F.lit(False)
    for n, (low, high) in SITE_RANGES.items():
        legal = legal | ((F.col(variable) == n) & number.between(low, high))
    for n in SITE_TEXT:
        legal = legal | ((F.col(variable) == n) & (F.trim(F.col(value)) != ""))
    kept = rows.filter(F.col(variable).isin(*names))
    aggs = []
    for n in names:
        v = F.when(F.col(variable) == n, F.trim(F.col(value)))
        aggs += [F.min(v).alias(f"_lo_{n}"), F.max(v).alias(f"_hi_{n}"), F.min(F.when(F.col(variable) == n, legal.cast("int"))).alias(f"_ok_{n}")]
    out = kept.groupBy(*site).agg(*aggs)
    cols, issues = [], []
    for n in names:
        good = (F.col(f"_lo_{n}") == F.col(f"_hi_{n}")) & (F.col(f"_ok_{n}") == 1)
        v = F.when(good, F.col(f"_lo_{n}"))
        cols.append((v.cast("double") if n in SITE_RANGES else v).alias(n))
        issues.append(F.when(F.col(f"_lo_{n}").isNull(), f"missing {n}").when(F.col(f"_lo_{n}") != F.col(f"_hi_{n}"), f"ambiguous {n}").when(F.col(f"_ok_{n}") == 0, f"invalid {n}"))
    return out.select(*site, *cols, F.array_join(F.array_compact(F.array(*issues)), ";").alias("issue"))


def pivot_groups(rows: DataFrame, keys: list[str], variables: list[str], group: str = "GROUP_ID", variable: str = "VARIABLE",
                 value: str = "DATAVALUE") -> DataFrame:
    """One column per variable of each metadata group, with a count of repeated variables."""
    picks = [F.max(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables]
    return rows.groupBy(*keys, group).agg(*picks, (F.count(variable) - F.count_distinct(variable)).alias("repeated"))


# Names in the metadata of instruments and of vegetation, and the statistics that a canopy's height may be.
INSTRUMENT, CANOPY = "GRP_VAR_INFO", "GRP_HEIGHTC"
CANOPY_STATISTICS = ("Mean", "90th Percentile")
_NAMES = {INSTRUMENT: ["VAR_INFO_VARNAME", "VAR_INFO_DATE", "VAR_INFO_HEIGHT"],
          CANOPY: ["HEIGHTC", "HEIGHTC_DATE", "HEIGHTC_DATE_END", "HEIGHTC_STATISTIC", "HEIGHTC_SPP", "HEIGHTC_VEG_STATUS"]}


def height_groups(rows: DataFrame, keys: list[str], kind: str, offset_h: str, variable_of: str = "USTAR") -> DataFrame:
    """Usable dated heights of raw metadata rows: keys, ``t_s``, ``statistic``, ``value``, and ``discarded`` instead of them.

    ``rows``: keys, ``offset_h`` (hours of local standard time before UTC), VARIABLE_GROUP, GROUP_ID, VARIABLE, DATAVALUE. Instruments
    count if they measure ``variable_of``. Canopies count if they are of no single species, alive or of
    unknown state, and of a known statistic; a range of days counts from its last. Dates have 8 or 12 digits. Groups that name a
    variable twice are discarded.
    """
    wide = pivot_groups(rows.filter(F.col("VARIABLE_GROUP") == kind), [*keys, offset_h], _NAMES[kind])
    text = {n: F.coalesce(F.trim(n), F.lit("")) for n in _NAMES[kind]}
    if kind == INSTRUMENT:
        mine = text["VAR_INFO_VARNAME"] == variable_of
        date, value, statistic = text["VAR_INFO_DATE"], text["VAR_INFO_HEIGHT"], F.lit("Mean")
    else:
        mine = (text["HEIGHTC_SPP"] == "") & text["HEIGHTC_VEG_STATUS"].isin("", "Alive") & text["HEIGHTC_STATISTIC"].isin(*CANOPY_STATISTICS)
        date = F.when(text["HEIGHTC_DATE"] != "", text["HEIGHTC_DATE"]).otherwise(text["HEIGHTC_DATE_END"])
        value, statistic = text["HEIGHTC"], text["HEIGHTC_STATISTIC"]
    out = wide.filter(mine).select(*keys, offset_h, "repeated", date.alias("_date"), value.alias("_value"), statistic.alias("statistic"))
    stamp = F.when(F.length("_date") == 8, F.try_to_timestamp(F.col("_date"), F.lit("yyyyMMdd"))).when(
        F.length("_date") == 12, F.try_to_timestamp(F.col("_date"), F.lit("yyyyMMddHHmm")))
    number = F.col("_value").try_cast("double")
    missing = F.col("_value").isin("", "-9999", "-9999.0") | stamp.isNull()
    bad = number.isNull() | F.isnan(number) | (number < 0) | (number == float("inf"))
    reason = F.when(F.col("repeated") > 0, "repeated_variable").when(missing, "missing_value_or_exact_date").when(bad, "invalid_height")
    return out.select(*keys, F.when(reason.isNull(), F.unix_seconds(stamp) - (F.col(offset_h) * 3600).cast("bigint")).alias("t_s"), "statistic",
                      F.when(reason.isNull(), number).alias("value"), reason.alias("discarded"))


def metadata_events(rows: DataFrame, keys: list[str], time: str = "t_s", statistic: str = "statistic", value: str = "value") -> DataFrame:
    """Dated events: the 90th percentile outranks the mean, other statistics do not count; different values of the top rank give a NULL event."""
    rank = F.when(F.col(statistic) == "90th Percentile", 1).when(F.col(statistic) == "Mean", 0)
    usable = rows.filter(rank.isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0))
    by_rank = usable.groupBy(*keys, time, rank.alias("_rank")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    best = by_rank.groupBy(*keys, time).agg(F.max_by(F.struct("_lo", "_hi"), "_rank").alias("_b"))
    same = F.col("_b._lo") == F.col("_b._hi")
    return best.select(*keys, time, F.when(same, F.col("_b._lo")).alias(value), (~same).alias("ambiguous"))
