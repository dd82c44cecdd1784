"""Session settings every plan relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "landtally", master: str | None = None, **conf) -> SparkSession:
    """Create a session; ``conf`` keys use ``__`` for the dots of a Spark setting."""
    builder = SparkSession.builder.appName(app).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


#: Bytes of an Arrow batch on its way to a Python worker: ten thousand long texts or arrays at once would fill it.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Calendar windows are UTC, on which every date function depends; Arrow batches are bounded in bytes."""
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def _private_folder(spark: SparkSession, prefix: str) -> str:
    """A folder of this machine, for tests; on a cluster executors would each see their own."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, so a lost executor costs no recomputation.

    The cluster names the shared folder in ``spark.checkpoint.dir``; a private folder is
    used only where that setting is absent (tests on one machine).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or _private_folder(df.sparkSession, "landtally-checkpoint-"))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch space; a private one only where the session names none."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _private_folder(spark, f"landtally-{name}-") + "/table"


#: Spark's own removal of a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table of the shared scratch space, read again.

    For loops: a checkpointed plan keeps the constraints of its history, which grow from round to round.
    Once the table is written, the shuffle files behind it are of no more use and are removed.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` into as many tasks as a shuffle has, ``least`` at the least, for CPU-heavy Arrow work.

    A fixed count keeps adaptive execution from merging partitions that are small in bytes but
    long in compute.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, least), *keys)
