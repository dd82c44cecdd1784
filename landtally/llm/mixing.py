"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / source size times. The whole part is given; the
fractional parts are rounded together: two documents trade probability until one of them is
decided, in such a way that the words they take stay the same. Chunks of bounded size do so
side by side; what is left undecided of each chunk, one document at most, goes on to the next level of
the tree, until one document per source remains. Only built-in column functions are used, and
all draws are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landtally.llm.store import stored

#: Rows that one chunk rounds; the tree has as many levels as the count has digits to this base.
CHUNK = 256
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
_UNITS = float(1 << 52)
#: Probabilities this close to 0 or 1 are decided.
_CLOSE = 1e-9


def sizes(text: Column) -> Column:
    """Words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) → with ``target``: weighted shares of all sizes, at most ``most`` times the source's own.

    Weights repeat along the sources in code-point order, NULL last. Sources are filled in the order of
    size to weight: a source is at its limit if its share of what the earlier ones leave exceeds it.
    That is where resharing the excess until no source is above its limit ends. The table has a row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = totals.select("source", "source_size", F.sum("source_size").over(Window.partitionBy()).alias("_all"), weight.alias("weight"))
    limit = most * F.col("source_size")
    tight = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    rest = tight.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_all") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    table = table.withColumn("_level", level).withColumn("_full", F.col("weight") * F.col("_level") >= limit)
    # The level at which the first source stays below its limit holds for all after it.
    open_level = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_level"))).over(Window.partitionBy())
    return table.select("source", "source_size", F.when(F.col("_full"), limit).otherwise(
        F.col("weight") * open_level["_level"]).alias("target"))


def _draw(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 12) / F.lit(_UNITS)


def _round_chunk(rows: Column, level: int) -> Column:
    """Fold a chunk of (size, key, p): decided rows as (key, one) and the undecided row, if any.

    The held row h and the next row r trade so that size_h * p_h + size_r * p_r stays: h moves by
    d / size_h while r moves by -d / size_r, up or down at random with the odds that keep each p in expectation.
    """
    row = "struct<size:double,key:bigint,p:double>"
    decided = "array<struct<key:bigint,one:int>>"
    start = F.struct(F.lit(None).cast(row).alias("held"), F.expr(f"cast(array() as {decided})").alias("done"))

    def step(a: Column, r: Column) -> Column:
        h = a["held"]
        up = F.least((1 - h["p"]) * h["size"], r["p"] * r["size"])     # words that h can take from r
        down = F.least(h["p"] * h["size"], (1 - r["p"]) * r["size"])   # words that h can give to r
        moved = F.when(_draw(h["key"], r["key"], F.lit(level)) * (up + down) < down, up).otherwise(-down)
        ph, pr = h["p"] + moved / h["size"], r["p"] - moved / r["size"]
        return F.when(h.isNull(), F.struct(r.cast(row).alias("held"), a["done"].alias("done"))).otherwise(
            _settle(h, r, ph, pr, a["done"], row))

    return F.aggregate(rows, start, step)


def _settle(h: Column, r: Column, ph: Column, pr: Column, done: Column, row: str) -> Column:
    def off(p):
        return (p <= _CLOSE) | (p >= 1 - _CLOSE)

    def rest(x, p):
        return F.struct(x["size"].alias("size"), x["key"].alias("key"), p.alias("p")).cast(row)

    def fate(x, p):
        return F.array(F.struct(x["key"].alias("key"), F.when(p >= 0.5, 1).otherwise(0).alias("one")))

    none = F.lit(None).cast(row)
    return F.when(off(ph) & off(pr), F.struct(none.alias("held"), F.concat(done, fate(h, ph), fate(r, pr)).alias("done"))).when(
        off(ph), F.struct(rest(r, pr).alias("held"), F.concat(done, fate(h, ph)).alias("done"))).otherwise(
        F.struct(rest(h, ph).alias("held"), F.concat(done, fate(r, pr)).alias("done")))


def pivotal_rounding(rows: DataFrame) -> DataFrame:
    """(source, key, size, p) with 0 < p < 1, size > 0 and distinct keys → (key, one).

    The sum of size times ``one`` over a source differs from that of size times p by at most half of one row's size.
    """
    levels = 0
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while CHUNK ** levels < largest:
        levels += 1
    left, out = rows.select("source", "key", F.col("size").cast("double").alias("size"), "p"), None
    for level in range(max(levels, 1)):
        counts = left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks")).withColumnRenamed("source", "_of")
        last = level == max(levels, 1) - 1
        chunk = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("key", F.lit(level)), F.col("_chunks"))
        dealt = left.join(counts, F.col("source").eqNullSafe(F.col("_of"))).select("source", "key", "size", "p", chunk.alias("_chunk"))
        grouped = dealt.groupBy("source", "_chunk").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "key", "p")))).alias("rows"))
        # From the largest document down: it trades with many smaller ones and is likely to be decided by them.
        folded = stored(grouped.select("source", _round_chunk(F.col("rows"), level).alias("f")), "mix")
        done = folded.select(F.explode("f.done").alias("d")).select("d.*")
        out = done if out is None else out.unionByName(done)
        left = folded.filter("f.held is not null").select("source", "f.held.*").select("source", "key", "size", "p")
    # One document per source is left, with nothing to trade with: the nearer side keeps the words near the target.
    final = left.select("key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("one"))
    return out.unionByName(final)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per document row: id, ``source``, ``_hash``, ``_turn``, ``size``, ``source_size``, ``target``, ``copies``.

    ``_turn`` numbers rows equal in id, source and text, which are rounded apart. Documents without
    words are copied 0 times; a mix without words has target 0.
    """
    twin = Window.partitionBy("id", "source", "_hash").orderBy("_hash")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("_hash"),
                       sizes(F.col(text_col)).alias("size")).withColumn("_turn", F.row_number().over(twin))
    rows = stored(rows, "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = stored(targets(totals, weights, most), "mix").select(F.col("source").alias("_of"), "source_size", "target")
    rows = rows.withColumn("key", F.xxhash64("id", "source", "_hash", "_turn"))
    placed = rows.join(shares, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    placed = placed.withColumn("_whole", F.floor(ratio + _CLOSE)).withColumn("_p", ratio - F.col("_whole"))
    open_rows = placed.filter((F.col("size") > 0) & (F.col("_p") > _CLOSE)).select("source", "key", "size", F.col("_p").alias("p"))
    decided = pivotal_rounding(open_rows)
    out = placed.join(decided, "key", "left")
    n = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce("one", F.lit(0))).otherwise(0).cast("int")
    return out.select("id", "source", "_hash", "_turn", "size", "source_size", "target", n.alias("copies"))


def report(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as ``copies`` says, and ``copy`` from 1 on.

    NULL sources are one source; rows with a NULL id or repeated rows are drawn row by row. Extra columns are kept; a column
    named ``copy`` is replaced.
    """
    docs = docs.drop("copy")
    drawn = copies(docs, id_col, text_col, source_col, **options).filter("copies > 0").select(
        F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("_hash").alias("_h"), F.col("_turn").alias("_t"), F.col("copies").alias("_n"))
    # The given columns travel as one, so that none of their names meets one of these.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                        F.xxhash64(text_col).alias("_key"))
    twin = Window.partitionBy("_id", "_source", "_key").orderBy("_key")
    joined = keyed.withColumn("_twin", F.row_number().over(twin)).join(
        drawn, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s"))
        & (F.col("_key") == F.col("_h")) & (F.col("_twin") == F.col("_t")))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
