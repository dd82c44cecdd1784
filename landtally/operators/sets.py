"""Unions, preferred duplicates, ledger replay and manifest merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landtally.functions import keys as K


def stack(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def preferred(df: DataFrame, keys: list[str], order: list[Column], flags: list[str] = ()) -> DataFrame:
    """Best row per key by ``order`` and the OR of ``flags`` over all its rows.

    An aggregate with map-side combine: a key with many copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in flags]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    out = df.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("copies"), *[F.max(f).alias(f) for f in flags])
    return out.select(*keys, "_b.*", *flags, "copies")


def bundle(members: DataFrame, identity: list[str], strata: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members at one place and time become one input candidate.

    Returns the representatives, the members with their ``input_candidate_id``, and the candidates
    whose members disagree on split or strata.
    """
    parts = [K.quoted(F.col(c)) for c in identity]
    keyed = members.withColumn("input_candidate_id", K.short_id(*parts))
    keyed = keyed.withColumn("has_sm", F.col("target") == "sm").withColumn("has_et", F.col("target") == "et")
    keyed = keyed.withColumn("has_et_footprint", F.col("has_et") & F.col("operator_ready"))
    order = [~F.col("operator_ready"), F.col("source_priority"), F.col("candidate_id")]
    chosen = preferred(keyed, ["input_candidate_id"], order, ["has_sm", "has_et", "has_et_footprint"])
    spread = [F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit(""))).alias(s) for s in strata]
    bad = keyed.groupBy("input_candidate_id").agg(*spread)
    bad = bad.filter(" or ".join(f"{s} > 1" for s in strata))
    return chosen.withColumnRenamed("copies", "members"), keyed.drop("has_sm", "has_et", "has_et_footprint"), bad


def replay(ledger: DataFrame, records: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Append records the ledger does not hold, then read the last status of every id."""
    fresh = records.join(ledger.select(key), key, "left_anti")
    whole = ledger.unionByName(fresh, allowMissingColumns=True)
    return whole.groupBy(key).agg(F.max_by(status, order).alias(status), F.count(F.lit(1)).alias("attempts"))


def merge_manifests(tables: list[DataFrame], identity: list[str], key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Earlier tables win. Returns kept rows and a report row per dropped duplicate or id collision."""
    tagged = stack(*[t.withColumn("source_order", F.lit(i)) for i, t in enumerate(tables)])
    window_id = K.fingerprint(*[K.quoted(F.col(c)) for c in identity])
    tagged = tagged.withColumn("_identity", window_id)
    first = tagged.groupBy("_identity").agg(F.min(F.struct("source_order", key)).alias("_first"))
    j = tagged.join(first, "_identity")
    kept = j.filter((F.col("source_order") == F.col("_first.source_order")) & (F.col(key) == F.col(f"_first.{key}")))
    dropped = j.join(kept.select(key, "source_order"), [key, "source_order"], "left_anti").select(
        key, "source_order", F.lit("duplicate").alias("issue"))
    clash = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("source_order").alias("source_order")).filter("_n > 1")
    report = dropped.unionByName(clash.select(key, "source_order", F.lit("id_collision").alias("issue")))
    return kept.drop("_first", "_identity"), report
