"""Deletion of repeated runs of lines by winnowing.

Lines are hashed; the window from a line on is the shortest run of lines with at least ``words``
words. The least line hash of a window is its fingerprint, which equal windows share wherever
they stand, so a run of that length can not repeat without a common fingerprint. Windows whose
fingerprint repeats are joined by content with the first position of that content; matches grow
right through the windows from each line on and left through the windows up to each line, and
lines of a later occurrence are deleted. Only built-in column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landtally.llm.store import stored

_WORD_GAP = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    """Words between white space; 0 for a blank line."""
    tight = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(tight == "", 0).otherwise(F.size(F.split(tight, _WORD_GAP)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines as (row key, position, number, hash, words), without their text; one copy of equal rows."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    split = docs.filter(F.col(text_col).isNotNull()).select(key.alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = split.select("doc", "pos", F.xxhash64(F.rtrim("line")).alias("hash"), _words(F.col("line")).alias("words"))
    # One exchange serves the distinct rows and all windows.
    return rows.filter("words > 0").repartition("doc").dropDuplicates(["doc", "pos"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """Positions (``doc`` key, ``pos``) of lines inside a run of at least ``words`` words that stood earlier.

    Earlier means: in a row with a lower (id, text hash), or further up in the same text without
    overlap. NULL ids sort first. Rows that are equal in id and text are one text here.
    """
    lines = _lines(docs, id_col, text_col)
    by_doc = Window.partitionBy("doc").orderBy("pos")
    # Words before a line and up to it increase strictly, so they frame windows by words.
    upto = F.sum("words").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("idx", F.row_number().over(by_doc)).withColumn("upto", upto).withColumn(
        "before", F.col("upto") - F.col("words"))
    right = Window.partitionBy("doc").orderBy("before").rangeBetween(0, words - 1)
    left = Window.partitionBy("doc").orderBy("upto").rangeBetween(-(words - 1), 0)
    framed = lines.select(
        "doc", "pos", "idx", F.sum("words").over(right).alias("_rw"), F.collect_list("hash").over(right).alias("_rh"),
        F.max("pos").over(right).alias("_re"), F.sum("words").over(left).alias("_lw"), F.collect_list("hash").over(left).alias("_lh"),
        F.min("pos").over(left).alias("_ls"), F.min("idx").over(left).alias("_li"))

    def window(side: int, full: str, hashes: str, idx: str, start: str, end: str) -> Column:
        mark = F.array_min(hashes)
        return F.when(F.col(full) >= words, F.struct(
            F.lit(side).alias("side"), mark.alias("mark"), (F.col(idx) + F.array_position(hashes, mark) - 1).alias("at"),
            F.xxhash64(hashes).alias("content"), F.xxhash64(F.lit(7), hashes).alias("check"),
            F.col(start).alias("start"), F.col(end).alias("end")))

    windows = framed.select("doc", F.explode(F.array_compact(F.array(
        window(0, "_rw", "_rh", "idx", "pos", "_re"), window(1, "_lw", "_lh", "_li", "_ls", "pos")))).alias("w")).select("doc", "w.*")
    windows = stored(windows, "lines")
    # A fingerprint that is chosen at one place only belongs to windows that can not repeat.
    spot = F.struct("doc", "at")
    marks = windows.groupBy("side", "mark").agg(F.min(spot).alias("_lo"), F.max(spot).alias("_hi")).filter(
        "_lo <> _hi").select("side", "mark")
    repeated = windows.join(marks, ["side", "mark"])
    content = ["side", "content", "check"]
    place = F.struct("doc", "start", "end")
    first = repeated.groupBy(*content).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter(
        "_first <> _last").drop("_last")
    later = repeated.join(first, content).filter(
        (F.col("doc") > F.col("_first.doc")) | ((F.col("doc") == F.col("_first.doc")) & (F.col("start") > F.col("_first.end"))))
    return later.select("doc", F.explode(F.sequence("start", "end")).alias("pos")).distinct()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """``docs`` with repeated runs deleted from the text, and ``n_lines`` and ``n_deleted`` added.

    Lines end at a line feed and are compared without trailing spaces. The first occurrence of a run
    stays whole; of a text that repeats an earlier text whole only blank lines stay. Blank lines
    make no run by themselves and go only inside a deleted run. NULL and empty texts are returned
    as they are. Rows equal in id and text are treated alike. Extra columns are kept; columns of
    the names that are added here are replaced.
    """
    gone = repeated_lines(docs, id_col, text_col, words).groupBy("doc").agg(F.collect_list("pos").alias("_gone")).select(
        F.col("doc.id").alias("_id"), F.col("doc.h").alias("_h"), "_gone")
    docs = docs.drop("n_lines", "n_deleted")
    # The given columns travel as one, so that none of their names meets one of these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"))
    joined = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    given = F.col("row")[text_col]
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("_gone").isNull(), given).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.withColumn("_lines", F.split(given, "\n")).select(
        *columns, F.when(given.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_deleted"))
