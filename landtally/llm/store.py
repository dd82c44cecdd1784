"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame

from landtally.session import scratch_folder

#: The folder of each table that :func:`stored` has returned.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's own removal of a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again.

    A lost executor then costs no recomputation, and the plans of later rounds start from a scan:
    a checkpointed plan keeps the constraints of its history, which double from round to round.
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
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`stored` that nothing will read again; others, and None, are left alone."""
    for table in tables:
        path = _FOLDERS.pop(table, None) if table is not None else None
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
