"""The corpus pipeline: five stages, each on all that the one before has kept.

Every stage is a function (spark, docs, sf_dir) → DataFrame; its result is written as Parquet and
read again as the next one's documents. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landtally.llm.decontaminate import clean
from landtally.llm.line_dedup import without_repeats
from landtally.llm.mixing import mix
from landtally.llm.near_dedup import keep_one
from landtally.llm.quality import draw, fit
from landtally.llm.store import stored
from landtally.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; what the model rejects, toxic text included, goes."""
    prepare(spark)
    return draw(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs of 50 words or more are deleted from the texts; every document stays."""
    prepare(spark)
    shorter = without_repeats(docs)
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return shorter.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component."""
    prepare(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: every document as often as the mix takes it, numbered by ``copy``."""
    prepare(spark)
    return mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mixing", mixing)]

#: The classifier and the mix are drawn by hash functions that SQL does not share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
