"""Text series: sensor files, half-hour flux files, station archives and point lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Markers of missing numbers in provider files.
MISSING = (-9999.0, -6999.0)
# Class names of the point lists and their numbers.
POINT_CLASSES = {"water": 0, "snow_ice": 1, "land": 2}
# Accepted column names, best first.
LE_COLUMNS = ("LE_CORR", "LE_F_MDS", "LE")
TIME_COLUMNS = ("TIMESTAMP_START", "TIMESTAMP", "DATE")


def find_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """First alias present, ignoring case."""
    lower = {c.lower(): c for c in columns}
    return next((lower[a.lower()] for a in aliases if a.lower() in lower), None)


def clean_number(col: Column) -> Column:
    """Provider number: missing markers and NaN become NULL."""
    v = col.try_cast("double")
    return F.when(~v.isin(*MISSING) & ~F.isnan(v), v)


def local_stamp(text: Column) -> Column:
    """``yyyyMMddHHmm`` as seconds of a zone-free clock."""
    return F.unix_seconds(F.try_to_timestamp(text.cast("string"), F.lit("yyyyMMddHHmm")))


def read_sensor_text(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return lines


def parse_sensor_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``yyyy/MM/dd HH:mm value flag provider_flag`` records; header and malformed lines drop out."""
    p = F.split(F.trim(value), r"\s+")
    stamp = F.try_to_timestamp(F.concat_ws(" ", p[0], F.get(p, F.lit(1))), F.lit("yyyy/MM/dd HH:mm"))
    rest = [c for c in lines.columns if c != value]
    out = lines.select(*rest, F.unix_seconds(stamp).alias("t_s"), F.get(p, F.lit(2)).try_cast("double").alias("value"),
                       F.get(p, F.lit(3)).alias("flag"), F.get(p, F.lit(4)).alias("provider_flag"))
    return out.filter("t_s is not null").withColumn("good", F.coalesce(F.col("flag") == "G", F.lit(False)))


def repeated_times(df: DataFrame, keys: list[str], time: str = "t_s", value: str = "value") -> DataFrame:
    """Times that carry different values: the series needs an explicit resolution."""
    from landtally.operators.checks import conflicts

    return conflicts(df, [*keys, time], value).select(*keys, time)


def parse_sensor_header(df: DataFrame, line: str) -> DataFrame:
    """Nine quoted fields: network, station, latitude, longitude, elevation, depth from, depth to, sensor, kind."""
    f = F.regexp_extract_all(line, F.lit(r'"([^"]*)"'), F.lit(1))
    names = ("network", "station", "lat", "lon", "elevation", "depth_from", "depth_to", "sensor", "kind")
    out = df
    for i, n in enumerate(names):
        v = F.get(f, F.lit(i))
        out = out.withColumn(n, v.try_cast("double") if n in ("lat", "lon", "elevation", "depth_from", "depth_to") else v)
    aggregated = F.lower("sensor").rlike("mean|average|aggregat")
    reason = (F.when(F.size(f) != 9, "malformed_header").when(F.col("depth_from").isNull() | F.col("depth_to").isNull(), "unknown_depth")
              .when((F.col("depth_from") < 0) | (F.col("depth_to") > 0.05), "not_shallow")
              .when(F.lower("kind") != "point", "not_point").when(aggregated, "aggregated_sensor"))
    return out.withColumn("reason", reason).withColumn("eligible", reason.isNull())


def read_flux_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).csv(path).withColumn("file", F.input_file_name())


def flux_intervals(df: DataFrame, offset_hours: Column, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Local standard interval rows to UTC seconds with clean numbers; only the named columns are read."""
    shift = (offset_hours * 3600).cast("bigint")
    return df.select(*keys, (local_stamp(F.col("TIMESTAMP_START")) - shift).alias("start_s"),
                     (local_stamp(F.col("TIMESTAMP_END")) - shift).alias("end_s"), *[clean_number(F.col(c)).alias(c) for c in columns])


def half_hour_file(name: Column) -> Column:
    """Only half-hour and hour files are interval series."""
    return name.rlike(r"_(HH|HR)_")


def evaporation(df: DataFrame, keys: list[str], time: str, le: str) -> DataFrame:
    """Water depth per interval from latent heat and each file's median step."""
    from landtally.operators.intervals import median_step

    steps = median_step(df, keys, time).select(*keys, "median_step_s")
    out = df.join(steps, keys)
    return out.withColumn("et_mm", F.col(le) * F.col("median_step_s") / 2.45e6)


def parse_points(df: DataFrame, geometry: str = "geometry", label: str = "label") -> DataFrame:
    """WKT ``POINT`` or one-member ``MULTIPOINT``, class numbers and domain reasons."""
    number = r"(-?\d+(?:\.\d+)?)"
    wkt = rf"^\s*(?:MULTI)?POINT\s*\(+\s*{number}\s+{number}\s*\)+\s*$"
    lon, lat = (F.nullif(F.regexp_extract(geometry, wkt, i), F.lit("")).try_cast("double") for i in (1, 2))
    classes = F.create_map(*[F.lit(x) for kv in POINT_CLASSES.items() for x in kv])
    out = df.withColumn("lon", lon).withColumn("lat", lat).withColumn("cls", F.try_element_at(classes, F.col(label)))
    return out


def point_reason(year: Column) -> Column:
    """Why a parsed point is not usable, NULL when it is."""
    return (F.when(F.col("lon").isNull() | F.col("lat").isNull(), "geometry").when(~F.col("lon").between(-180, 180) | (F.col("lat") < -60) | (F.col("lat") >= 84), "domain")
            .when(~year.between(2017, 2024), "year").when(F.col("cls").isNull(), "class"))


def source_index(records: DataFrame, file: str, time: str) -> DataFrame:
    """First and last record and number of records of each file."""
    return records.groupBy(file).agg(F.min(time).alias("first_s"), F.max(time).alias("last_s"), F.count(F.lit(1)).alias("records"))


def columns_like(columns: Column, pattern: str) -> Column:
    return F.filter(columns, lambda c: c.rlike(pattern))


def archive_series(df: DataFrame, depth_limit: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Series no deeper than the limit and inside the area, with standard value and flag names."""
    x0, y0, x1, y1 = box
    ok = (F.col("depth_to") <= depth_limit) & F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1)
    return df.filter(ok)


# Source name -> parser of its raw lines; users add their own entries.
READERS = {"sensor_text": parse_sensor_lines, "points": parse_points}
