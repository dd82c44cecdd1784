"""What each of several text filters removes, in every order in which they could run.

A document's failures are bits of a mask, and everything the audit tells of an order follows from how many documents of
a part have each mask. Texts are compared in full, but only those that a counting Bloom filter cannot clear: a text
whose counters were not all met twice is certainly the only one of its kind and is never shuffled.
"""

from __future__ import annotations

import itertools
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from landtally.llm.hot import join_counted
from landtally.llm.sketch import met
from landtally.llm.store import stored

FILTERS = "ABCDE"
_UPPER, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"


def _fails(text: bytes, points: int) -> int:
    """Bits of A to D. ``bytes.split`` parts at exactly the six separators x20 and x09-x0D."""
    words = text.split()
    n = len(words)
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * points) << 2
            | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, h, code) per document: bits of A to D, a hash and the SHA-256 of the whole text; NULL text and part are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("code"), "text")

    def run(batches):
        for batch in batches:
            texts, points = batch.column(4), pc.utf8_length(batch.column(4))
            mask = [_fails(t.as_py().encode(), n.as_py()) for t, n in zip(texts, points)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), batch.column(2), batch.column(3)],
                                  names=["doc_id", "part", "mask", "h", "code"])

    return rows.mapInArrow(run, "doc_id long, part string, mask int, h long, code binary")


def repeats(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """(doc_id, part, mask) of the rows of ``rows`` (as of :func:`masks`, stored) whose text a smaller id holds too.

    Repeated rows of an id do not repeat each other; a NULL id is neither smaller nor larger than another.
    """
    possible = met(rows.select("h"), times=2, bits=counters)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    firsts = texts.filter(possible(F.xxhash64("text"))).groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = stored(firsts.select(F.unhex(F.sha2("text", 256)).alias("code"), "first", "n"), "firsts")
    candidates = stored(rows.filter(possible(F.col("h"))).select("doc_id", "part", "mask", "code"), "candidates")
    return join_counted(candidates, firsts, "code", "n").filter("doc_id > first").select("doc_id", "part", "mask")


def mask_counts(rows: DataFrame, again: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by all five bits; those of ``again`` move from their mask to that with E."""
    moved = again.select("doc_id", "part", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.lit(-1).alias("w")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("w")))).alias("m"))
    each = rows.select("doc_id", "part", "mask", F.lit(1).alias("w")).unionByName(moved.select("doc_id", "part", "m.*"))
    each = each.groupBy("doc_id", "part", "mask").agg(F.sum("w").alias("w")).filter("w <> 0")
    told = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = each.join(told, "doc_id", "left")
    count = [F.sum("w").alias("n"), *[F.sum(F.col("w") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    return joined.groupBy("part", "mask").agg(*count)


def _orders() -> Column:
    """All orders of the filters and their steps, with the step's bit and the bits before it."""
    rows = [{"o": "".join(o), "s": k + 1, "bit": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in o[:k])}
            for o in itertools.permutations(FILTERS) for k, f in enumerate(o)]
    return F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<o:string,s:int,bit:int,before:int>>")).alias("q")


def interactions(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the mask counts of the parts; every part has at most 32 of them."""
    masked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c")).select("part", "c", _orders())
    bit, before = F.col("q.bit"), F.col("q.before")

    def total(test, value=lambda x: x["n"]):
        return F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda a, x: a + value(x))

    def here(x):
        return (x["mask"].bitwiseAND(bit) != 0) & (x["mask"].bitwiseAND(before) == 0)

    return masked.select(
        "part", F.col("q.o").alias("filter_order"), F.col("q.s").alias("step"),
        total(lambda x: x["mask"].bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda x: (x["mask"].bitwiseAND(bit) != 0) & (x["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda x: x["mask"] == bit).alias("unique_fails"), total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # Of all orders, those with the filter before a mask's other bits are 120 over the number of bits.
        total(lambda x: x["mask"].bitwiseAND(bit) != 0, lambda x: (x["n"] * 120 / F.bit_count(x["mask"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          counters: int | None = None) -> DataFrame:
    """Per part, order of the filters A to E and step: documents kept, removed, failing earlier, failing here only, and labels lost.

    NULL texts and parts are empty. Every row of ``docs`` counts as a document; a NULL id has no label and repeats nothing. Of several
    label rows of a document any with quality 1, or toxic 1, counts. Very long texts are taken whole, one at a time. An
    empty table has no part and no row; empty labels lose nothing. Other columns are ignored.
    """
    rows = stored(masks(docs, id_col, text_col, part_col), "masks")
    again = repeats(docs, rows, id_col, text_col, counters)
    return interactions(mask_counts(rows, again, labels, id_col))
