"""Near-duplicate documents by b-bit MinHash.

Every document gets 256 minima over its distinct word shingles. Bands of full minima propose
candidates, the low four bits of the minima, packed into longs, estimate the similarity
corrected for chance collisions by bit counts, and links are confirmed on the full shingle sets.

Documents with the same set are one node. In a band bucket the nodes are first compared with
leaders (a star, not all pairs); what is linked becomes one component, and only buckets that
still hold several components go on to pairs between components, bounded by the shingles that
another component holds at all. So a large group of copies costs a few comparisons per member
and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landtally.llm import words as W
from landtally.llm.graph import components
from landtally.llm.sketch import met
from landtally.llm.store import discard, stored

#: Minima per document, of which the first BANDED make bands of BAND; low bits kept of every minimum.
#: The few texts that are left after the leaders get the single low bits of WIDE minima.
MINIMA, BANDED, BAND, BITS, WIDE = 256, 128, 4, 4, 1024
#: A pair at the threshold has five standard deviations of room below its expected estimate.
SLACK_SIGMAS = 5.0
#: Nodes of a bucket that meet in one task.
BLOCK = 512

_RNG = np.random.default_rng(5)
_TIMES = (_RNG.integers(0, 1 << 32, WIDE, dtype=np.uint32) | np.uint32(1))
_PLUS = _RNG.integers(0, 1 << 32, WIDE, dtype=np.uint32)
_SPREAD = W.mix(_RNG.integers(0, 1 << 64, BAND, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words give none."""
    hashes, bounds = W.word_hashes(texts, W.SPACED)
    grams = W.gram_hashes(hashes, size)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo:hi - size + 1]))
        else:
            out.append(W.gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.empty(0, dtype=np.uint64))
    return out


def minima(shingles: np.ndarray, count: int = MINIMA) -> np.ndarray:
    times, plus = _TIMES[:count], _PLUS[:count]
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, np.uint32(0xFFFFFFFF))
    for at in range(0, len(short), 1024):
        table = short[at:at + 1024, None] * times
        table += plus
        np.minimum(best, table.min(axis=0), out=best)
    return best


def packed_bits(table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A few bits of each row's minima, mixed with the number of their function, packed into longs.

    The low bits of a minimum itself follow from those of its shingle: two shingles would collide in all functions or in none.
    """
    lanes = 64 // bits
    mixed = W.mix(table.astype(np.uint64) | (np.arange(1, table.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))
    low = (mixed & np.uint64((1 << bits) - 1)).reshape(len(table), -1, lanes)
    return (low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)


def _node(shingles: np.ndarray) -> int:
    """Name of a set: order-free sums of its members, mixed."""
    if not len(shingles):
        return 0
    total = W.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * W.mix(
        np.bitwise_xor.reduce(W.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True))
    return int(W.signed(W.mix(total))[0])


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, texts in W.blocks(batch.column(1)):
                sets = shingle_sets(texts, size)
                counts = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                table = np.stack([minima(s) for s in sets]) if sets else np.empty((0, MINIMA), np.uint32)
                bands = table[:, :BANDED].reshape(len(sets), -1, BAND).astype(np.uint64)
                keys = (bands * _SPREAD).sum(axis=2, dtype=np.uint64) + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                packed = packed_bits(table)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, len(texts)).cast(pa.int64()), pa.array(counts),
                    pa.array([_node(s) for s in sets], pa.int64()),
                    W.list_array(W.signed(W.mix(keys)).ravel(), np.full(len(sets), keys.shape[1])),
                    W.list_array(W.signed(packed).ravel(), np.full(len(sets), packed.shape[1]))],
                    names=["id", "n", "node", "keys", "packed"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in W.blocks(batch.column(1)):
                nodes = batch.column(0).slice(begin, len(texts)).to_pylist()
                # An id may stand on rows with other texts: only the text of the named node counts.
                own = [(n, s) for n, s in zip(nodes, shingle_sets(texts, size), strict=True) if _node(s) == n]
                sets = [s for _, s in own]
                yield pa.RecordBatch.from_arrays([
                    pa.array([n for n, _ in own], pa.int64()),
                    W.list_array(W.signed(np.concatenate([np.empty(0, np.uint64), *sets])),
                                 np.fromiter(map(len, sets), np.int64, len(sets)))], names=["node", "set"])
    return run


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
        table = np.stack([minima(x, WIDE) for x in sets]) if sets else np.empty((0, WIDE), np.uint32)
        packed = packed_bits(table, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), W.list_array(W.signed(packed).ravel(), np.full(len(sets), packed.shape[1]))], names=["node", "packed"])


def estimate(left: Column, right: Column, minima: int = MINIMA, bits: int = BITS) -> Column:
    """Similarity from packed low bits: differing lanes by bit counts, corrected for chance matches."""
    ones = sum(1 << k for k in range(0, 64, bits))
    differ = F.lit(0)
    for k in range(minima * bits // 64):
        x = left[k].bitwiseXOR(right[k])
        shift = 1
        while shift < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)) if bits > 1 else x)
    chance = 1.0 / (1 << bits)
    return (1.0 - differ / F.lit(float(minima)) - chance) / (1.0 - chance)


def _floor(percent: int, minima: int = MINIMA, bits: int = BITS) -> float:
    chance = 1.0 / (1 << bits)
    match = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK_SIGMAS * (match * (1 - match) / minima) ** 0.5 / (1 - chance)


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and packed signatures allow the threshold, with the estimate."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("packed").alias("_pa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("packed").alias("_pb"))
    close = estimate(F.col("_pa"), F.col("_pb"))
    return pairs.join(left, "a").join(right, "b").filter(
        100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")).select(
        "a", "b", close.alias("estimate")).filter(F.col("estimate") >= _floor(percent))


def _node_sets(named: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, set) of the named nodes, from their texts. Texts of other nodes stay where they are: a sketch of the owners tells them."""
    owners = stored(nodes.join(named, "node", "left_semi").select(F.col("owner").alias("key"), "node"), "owners")
    own = docs.filter(met(owners.select(F.col("key").alias("h")))(F.col("key")))
    # The exchange of a merge join keeps the two Python steps in stages of their own: a core never feeds two workers.
    sets = stored(own.join(owners.hint("merge"), "key").select("node", "text").mapInArrow(_sets(size), "node long, set array<long>").dropDuplicates(["node"]), "sets")
    discard(owners)
    return sets


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. Only texts of the named nodes are read into sets."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _node_sets(named, nodes, docs, size)
    links = _linked(pairs, sets, percent)
    discard(sets)
    return links


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("_sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("_sb")), "b")
    shared = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.size("_sa").cast("long") + F.size("_sb") - shared
    return stored(both.filter(100 * shared >= percent * union).select("a", "b"), "near")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 75, stars: int = 2) -> DataFrame:
    """One row per document row: id, ``n_shingles``, ``class_id``, ``component_id``, ``kept``.

    Links: ``100 * |A & B| >= percent * |A | B|`` on sets of ``size``-word shingles (A-Z lower-cased,
    words between white space; a shorter text is one shingle). ``component_id`` is the least id
    reachable by links and ``kept`` marks it. Texts without words (also NULL) have an empty set,
    link with nothing and are their own component. A NULL id takes part in links; its row is
    kept only if no row with an id is in its component. Repeated rows each return a row.
    Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Band i has its own offset in the key, so keys of different bands meet only by chance.
    sigs = stored(docs.mapInArrow(_signatures(size), "id long, n long, node long, keys array<long>, packed array<long>"), "near")
    keyed = docs.withColumn("key", F.coalesce("id", F.xxhash64("text")))
    nodes = sigs.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("packed").alias("packed"))
    without = keyed.filter("id is null").select(F.col("key").alias("owner"), "text").mapInArrow(
        _owner_nodes(size), "owner long, node long").groupBy("node").agg(F.min("owner").alias("owner"))
    nodes = nodes.join(without, "node", "left").withColumn("owner", F.coalesce("low", "owner"))
    nodes = stored(nodes, "near")
    heads = stored(sigs.select("id", "n", "node"), "near")
    discard(sigs)
    buckets = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    members = stored(buckets.join(sizes, "key"), "near")
    # A text that others are copies of shares more buckets with them than they do with each other: it leads.
    weight = members.groupBy("node").agg(F.sum("_size").alias("_weight"))
    sized, members = members, stored(members.join(weight, "node").select("key", "node", "_weight"), "near")
    discard(sized)

    found: list[DataFrame] = []
    belongs = None
    for _ in range(stars):
        open_members = members if belongs is None else _mixed(members, belongs)
        # Everyone against the heaviest node of the bucket, then of what is apart from the heaviest component.
        lead = open_members.groupBy("key").agg(F.max(F.struct("_weight", "node")).alias("_lead")).select("key", F.col("_lead.node").alias("b"))
        star = open_members.join(lead, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
        if belongs is not None:
            star = _apart(star, belongs)
        likely = _likely(star, nodes, percent)
        best = likely.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("_best")).select("a", F.col("_best.b").alias("b"))
        best = stored(best, "near")
        new = _confirmed(best, nodes, keyed, size, percent)
        found.append(new)
        discard(best, belongs)
        belongs = components(_union(found))

    # What stars have not joined: pairs of different components in one bucket.
    mixed = stored(_mixed(members, belongs).select("key", "node", "component"), "near")
    discard(members)
    able = _able(mixed, nodes, keyed, size, percent)
    placed = stored(mixed.join(able.drop("set"), ["node", "component"]), "near")
    discard(mixed)
    pairs = stored(_bucket_pairs(placed, percent), "near")
    if not pairs.isEmpty():
        found.append(_linked(pairs, able.select("node", "set"), percent))
        discard(belongs)
        belongs = components(_union(found))
    discard(placed, pairs, able, *found)

    groups = nodes.select("node", "low").join(belongs, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    named = groups.join(least, "component").select("node", F.col("low").alias("class_id"), "component_id")
    out = heads.join(named, "node", "left")
    own = F.col("n") == 0
    label = F.when(own, F.col("id")).otherwise(F.col("component_id"))
    verdict = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                                label.alias("component_id"), F.coalesce(label == F.col("id"), label.isNull()).alias("kept")), "verdict")
    discard(heads, nodes, belongs)
    return verdict


def _union(tables: list[DataFrame]) -> DataFrame:
    return tables[0] if len(tables) == 1 else tables[0].union(_union(tables[1:]))


def _bucket_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components in one bucket that their bounds and wide signatures allow.

    A large bucket is dealt into blocks, and every pair of its blocks meets under a key of its own.
    """
    sizes = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    dealt = placed.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    left = dealt.withColumn("j", F.explode(F.filter(others, lambda j: j >= F.col("i")))).alias("l")
    right = dealt.withColumnRenamed("i", "j").withColumn("i", F.explode(F.filter(others, lambda i: i <= F.col("j")))).alias("r")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
                      & ((F.col("l.i") < F.col("l.j")) | (F.col("l.node") < F.col("r.node"))) & (F.col("l.component") != F.col("r.component"))
                      & (100 * F.least("l.most", "r.most") >= percent * (F.col("l.n") + F.col("r.n") - F.least("l.most", "r.most")))
                      & (estimate(F.col("l.packed"), F.col("r.packed"), WIDE, 1) >= _floor(percent, WIDE, 1))
                      & (F.get(F.array_intersect("l.keys", "r.keys"), 0) == F.col("l.key")))  # once, in the first common bucket
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _mixed(members: DataFrame, belongs: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    placed = members.join(belongs, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi")
    return placed.join(mixed.select("key"), "key")


def _able(placed: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The nodes that may link outside their component: (node, component, n, keys, packed, most, set).

    ``most`` bounds every overlap exactly. It counts the node's shingles that another of the nodes holds, then,
    for what this leaves, the shingles that a node of another component holds.
    """
    def enough(table: DataFrame) -> DataFrame:
        return table.filter(100 * F.col("most") >= percent * F.col("n"))

    there = stored(placed.select("node", "component").distinct(), "near")
    every = _node_sets(there.select("node"), nodes, docs, size)
    alone = every.select("node", F.explode("set").alias("g")).groupBy("g").agg(
        F.count(F.lit(1)).alias("_c"), F.min("node").alias("node")).filter("_c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
    first = there.join(nodes.select("node", "n"), "node").join(alone, "node", "left").withColumn(
        "most", F.col("n") - F.coalesce("_alone", F.lit(0)))
    left = stored(enough(first).select("node", "component"), "near")
    sets = stored(every.join(left, "node"), "near")
    discard(there, every, left)
    held = sets.select("node", "component", F.explode("set").alias("g"))
    foreign = held.groupBy("g").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("g")
    most = held.join(foreign, "g").groupBy("node", "component").agg(F.count(F.lit(1)).alias("most"))
    wide = sets.select("node", "set").mapInArrow(_widened, "node long, packed array<long>")
    able = stored(enough(most.join(nodes.select("node", "n", "keys"), "node")).join(sets.select("node", "set"), "node").join(wide, "node"), "near")
    discard(sets)
    return able


def _apart(pairs: DataFrame, belongs: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be in one component."""
    a = belongs.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = belongs.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(
        F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _owner_nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in W.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(texts)),
                    pa.array([_node(s) for s in shingle_sets(texts, size)], pa.int64())], names=["owner", "node"])
    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each near-duplicate component left; columns as given.

    Rows with a NULL id and repeated rows of a kept id stay, as nothing tells which to drop.
    """
    verdict = near_duplicates(docs, id_col, text_col, **options)
    name = _free(docs)
    gone = stored(verdict.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(name)).distinct(), "gone")
    discard(verdict)
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")


def _free(docs: DataFrame) -> str:
    """A column name that the documents do not use."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    return name
