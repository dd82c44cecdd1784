"""Parquet manifests and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from landtally.operators import checks

# Columns every sample manifest must carry.
MANIFEST = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("crs", T.StringType()), T.StructField("transform", T.StringType()), T.StructField("target_time", T.DateType()),
    T.StructField("split", T.StringType()), T.StructField("input_shard", T.StringType()), T.StructField("input_row", T.LongType()),
    T.StructField("label_shard", T.StringType()), T.StructField("label_row", T.LongType()),
])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Refuse a table that lacks required columns (schema only, no job)."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def read_manifest(spark: SparkSession, path: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The manifest, and the rows whose stored split is not the recomputed one."""
    df = require(spark.read.parquet(path), MANIFEST.fieldNames())
    return df, checks.split_mismatch(df, "sample_id", "split", "lon", "lat", seed)


def write_manifest(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",)) -> None:
    """The output committer publishes all files or none; nested columns stay native."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append-only attempts ledger, one JSON object per line."""
    df.write.mode("append").json(path)


def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(F.col(column), schema))


def encode_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(F.col(column)))


def scene_catalog(df: DataFrame, name: str = "name") -> DataFrame:
    """Date and tile from scene names; one row per scene id, in scene order."""
    stamp = F.regexp_extract(name, r"(20\d{6})", 1)
    tile = F.regexp_extract(name, r"_T(\d{2}[A-Z]{3})_", 1)
    out = df.withColumn("date", F.try_to_date(F.nullif(stamp, F.lit("")), "yyyyMMdd")).withColumn("tile", F.nullif(tile, F.lit("")))
    rest = [c for c in out.columns if c != "scene_id"]
    return out.groupBy("scene_id").agg(F.min(F.struct(*rest)).alias("_r")).select("scene_id", "_r.*")


def label_records(manifest: DataFrame, records: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Records joined to known samples, and violations: repeated or unknown ids."""
    twice = checks.duplicates(records, [key]).select(key, F.lit("duplicate").alias("violation"))
    unknown = records.select(key).join(manifest.select(key), key, "left_anti").select(key, F.lit("unknown").alias("violation"))
    return manifest.join(records, key), twice.unionByName(unknown)
