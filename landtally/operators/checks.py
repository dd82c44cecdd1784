"""Constraint checks: every function returns the rows that break the rule, empty when it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from landtally.functions import keys as K
from landtally.operators.ordered import neighbour


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_ids(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value; min and max decide without a distinct shuffle."""
    out = df.groupBy(*keys).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(F.lit(1)).alias("rows"))
    return out.filter("lowest <> highest")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and row. A NULL outcome counts as broken. One pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))


def split_mismatch(df: DataFrame, key: str, split: str, lon: str, lat: str, seed: int) -> DataFrame:
    want = K.geographic_split(F.col(lon), F.col(lat), seed)
    return df.withColumn("expected_split", want).filter(F.col(split) != F.col("expected_split")).select(key, split, "expected_split")


def close_dates(df: DataFrame, keys: list[str], day: str, gap_days: int) -> DataFrame:
    """Successive distinct dates of one key that are closer than the gap."""
    rows = df.select(*keys, F.unix_date(day).alias("_d")).distinct()
    out = neighbour(rows, keys, "_d", "_d", "_n", 3650).filter(F.col("_n") - F.col("_d") < gap_days)
    return out.select(*keys, F.date_from_unix_date("_d").alias(day), (F.col("_n") - F.col("_d")).alias("gap"))


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    return conflicts(df, [group], split).select(group)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side that lacks them."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").filter(F.col("_l").isNull() | F.col("_r").isNull()).select(
        key, F.when(F.col("_r").isNull(), "right").otherwise("left").alias("missing_from"))


def changed_rows(selection: DataFrame, source: DataFrame) -> DataFrame:
    """Selected rows that are not in the source with the same values in every column."""
    return selection.select(*source.columns).exceptAll(source)


def support_mismatch(a: DataFrame, b: DataFrame, key: str, support: str, labelled: str) -> DataFrame:
    """Keys whose support differs between two variants, or that are labelled without support."""
    x = a.select(key, F.col(support).alias("_sa"), F.col(labelled).alias("_la"))
    y = b.select(key, F.col(support).alias("_sb"), F.col(labelled).alias("_lb"))
    j = x.join(y, key, "full")
    reason = (F.when(F.col("_sa").isNull() | F.col("_sb").isNull(), "missing_variant").when(F.col("_sa") != F.col("_sb"), "support_differs")
              .when((F.col("_la") & ~F.col("_sa")) | (F.col("_lb") & ~F.col("_sb")), "label_without_support"))
    return j.select(key, reason.alias("violation")).filter("violation is not null")


def row_fingerprints(df: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    """Hash of the columns as a list of strings; NULL and the empty string, and values with separators in them, stay apart."""
    return df.withColumn(name, K.fingerprint(*[K.quoted(F.col(c)) for c in columns]))


def table_fingerprint(df: DataFrame, key: str, columns: list[str], digits: int = 3) -> DataFrame:
    """One hash of a whole table, independent of partitioning.

    Rows hash first; rows of one key-hash bucket combine in key order into a bucket hash; the 4096
    bucket hashes combine into one. Buckets stay small because every bucket digest is folded
    from per-slice digests of at most a few thousand rows each.
    """
    rows = row_fingerprints(df, columns).withColumn("_k", F.sha2(F.col(key).cast("string"), 256))
    fine = rows.groupBy(F.substring("_k", 1, digits + 5).alias("_slice")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "fingerprint"))), lambda s: s["fingerprint"]), ""), 256).alias("_h"), F.count(F.lit(1)).alias("_n"))
    for width in (digits + 2, digits, 0):
        fine = fine.groupBy(F.substring("_slice", 1, width).alias("_s")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_slice", "_h"))), lambda s: s["_h"]), ""), 256).alias("_h"), F.sum("_n").alias("_n")
        ).withColumnRenamed("_s", "_slice")
    return fine.select(F.col("_h").alias("fingerprint"), F.col("_n").alias("rows"))


def quota_shortfall(df: DataFrame, bin_: str, quotas: DataFrame) -> DataFrame:
    have = df.groupBy(bin_).agg(F.count(F.lit(1)).alias("have"))
    return quotas.join(have, bin_, "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < quota")


def spacing_conflicts(df: DataFrame, key: str, zone: str, x: str, y: str, day: str, reach_m: float, gap_days: int) -> DataFrame:
    """Rows that meet some other row in space and time. Existence only, by cell extremes first.

    Bucket cells share a row only with cells that can conflict. In its own cell a row conflicts as soon as
    another row is there (cell size and bucket length equal the limits); neighbours are tested against
    distinct positions.
    """
    rows = df.select(key, F.col(zone).alias("_z"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.unix_date(day).alias("_d"))
    rows = rows.withColumn("_bx", F.floor(F.col("_x") / reach_m)).withColumn("_by", F.floor(F.col("_y") / reach_m)).withColumn("_bt", F.floor(F.col("_d") / gap_days))
    cell = ["_z", "_bx", "_by", "_bt"]
    crowd = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(crowd, cell)
    inside = rows.filter("_n > 1").select(key)
    # Lone rows: neighbours are compared with distinct positions only.
    lone = rows.filter("_n = 1")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)])
    moved = lone.withColumn("_o", F.explode(steps)).select(
        key, "_z", "_x", "_y", "_d", (F.col("_bx") + F.col("_o.i")).alias("_bx"), (F.col("_by") + F.col("_o.j")).alias("_by"), (F.col("_bt") + F.col("_o.k")).alias("_bt")).alias("l")
    spots = rows.select(*cell, F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), F.col("_d").alias("_od")).distinct().alias("r")
    near = ((F.abs(F.col("l._x") - F.col("r._ox")) < reach_m) & (F.abs(F.col("l._y") - F.col("r._oy")) < reach_m) & (F.abs(F.col("l._d") - F.col("r._od")) < gap_days))
    same = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in cell])
    across = moved.join(spots, same & near, "left_semi").select(key).distinct()
    return inside.unionByName(across)
