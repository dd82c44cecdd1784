"""Joins with a table of unique keys where a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with at least 1/HOT of all rows is hot, so that there are at most HOT hot keys.
HOT = 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str, n_col: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which holds each key once with the number ``n_col`` of its rows.

    The hot keys, at most ``HOT`` by their counts, are broadcast; every other key holds less than
    1/HOT of the rows, and is shuffled. ``rows`` and ``table`` are read twice: give stored tables.
    NULL keys join nothing.
    """
    total = table.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0]
    least = max(2.0, total / HOT)
    hot, cold = table.filter(F.col(n_col) >= least), table.filter(F.col(n_col) < least)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(cold, key))
