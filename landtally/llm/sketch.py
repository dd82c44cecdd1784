"""Bit sketches of hashes: which rows certainly need not be shuffled for a join or a count."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bits a hash meets; bits per hash, and the most of them: 32 MB, whatever the size of the table. A fuller sketch
#: clears fewer rows and changes no result.
HASHES, PER_HASH, MOST = 3, 16, 1 << 28
_SLICE = 32768


def _places(h: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def met(hashes: DataFrame, times: int = 1, bits: int | None = None) -> Callable[[Column], Column]:
    """From a column ``h``, a condition on such columns that is false only for values in fewer than ``times`` rows of it.

    The counters are a grouped count, so each task's own sketch is combined before the shuffle and the merged one is exact. Only
    one bit per counter comes back, at most ``MOST`` bits. NULL is a value like others.
    """
    if bits is None:
        bits = 1 << min(MOST.bit_length() - 1, max(15, (PER_HASH * hashes.count() - 1).bit_length()))
    counted = hashes.select(F.explode(F.array_distinct(F.array(*_places(F.col("h"), bits)))).alias("p")).groupBy("p").count()
    one = F.col("p") + 1
    slices = counted.filter(F.col("count") >= times).groupBy(F.bitmap_bucket_number(one).alias("slice")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    table = np.zeros((-(-bits // _SLICE), _SLICE // 8), np.uint8)
    for row in slices.toLocalIterator():
        table[row["slice"] - 1] = np.frombuffer(row["bits"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def found(p: pd.Series, q: pd.Series, r: pd.Series) -> pd.Series:
        sketch, out = shared.value, np.ones(len(p), bool)
        for place in (p, q, r):
            at = place.to_numpy(np.int64)
            out &= (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return lambda h: found(*_places(h, bits))
