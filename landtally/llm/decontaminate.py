"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of documents of bounded size. Its words are numbered and its suffixes sorted to
the depth of a window; every suffix of the benchmark items is then looked up by binary search,
which yields the places of all verbatim matches. Benchmark items are a table of blocks of bounded
size; a pass over the texts looks up a bounded number of blocks, and what it has found is stored before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landtally.llm import words as W
from landtally.llm.store import discard, stored

#: Bytes of the texts of a shard, of the items of a block, blocks of a pass, and matches that a task spreads out at once.
SHARD_BYTES, ITEM_BLOCK_BYTES, PASS_BLOCKS, MATCHES = 2 << 20, 4 << 20, 8, 1 << 20

_STATE = "n_words long, spans array<long>, items array<string>, longest long"


class SuffixArray:
    """Suffixes of a word sequence in lexicographic order of their first ``depth`` words (0 ends a text)."""

    def __init__(self, ranks: np.ndarray, vocabulary: int, depth: int):
        bits = max(1, int(vocabulary + 1).bit_length())
        self.bits, self.per = bits, max(1, min(depth, 63 // bits))
        padded = np.concatenate((ranks, np.zeros(depth + 2 * self.per, dtype=np.int64)))
        n = len(ranks) + depth + self.per
        self.keys = self.pack([padded[k:k + n] for k in range(self.per)])
        self.order = np.argsort(self.keys[:len(ranks)], kind="stable")
        self.first = self.keys[self.order]
        same = self.first[1:] == self.first[:-1]
        for at in range(self.per, depth, self.per):
            tied = np.zeros(len(self.order), dtype=bool)
            tied[1:] |= same
            tied[:-1] |= same
            where = np.flatnonzero(tied)
            if not len(where):
                break
            begins = np.concatenate(([True], ~same))
            group = np.cumsum(begins)[where]
            following = self.keys[self.order[where] + at]
            turn = np.lexsort((following, group))
            self.order[where] = self.order[where][turn]
            # Neighbours stay tied if their following words are equal too.
            sorted_next = np.full(len(self.order), -1, dtype=np.int64)
            sorted_next[where] = following[turn]
            same &= sorted_next[1:] == sorted_next[:-1]

    def pack(self, ranks: list[np.ndarray]) -> np.ndarray:
        key = np.zeros_like(ranks[0], dtype=np.int64)
        for k in range(self.per):
            key = (key << self.bits) | (ranks[k] if k < len(ranks) else 0)
        return key

    def ranges(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of word numbers (0 fills up shorter ones) the stretch of the suffixes that begin with them: all searched at once."""
        n, length = windows.shape
        used = (windows > 0).sum(axis=1)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        for at in range(0, length, self.per):
            part = [windows[:, at + k] if at + k < length else np.zeros(n, np.int64) for k in range(self.per)]
            low = self.pack(part)
            open_words = np.clip(at + self.per - used, 0, self.per)
            high = low + (np.int64(1) << (self.bits * open_words))
            # A window that has ended takes its stretch as it is.
            live = used > at
            lo[live], hi[live] = (self._bound(lo[live], hi[live], at, key[live]) for key in (low, high))
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, at: int, key: np.ndarray) -> np.ndarray:
        """The first suffix of each stretch whose words from ``at`` on are not below the key."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            middle = (lo + hi) >> 1
            inside = lo < hi
            place = self.order[np.minimum(middle, len(self.order) - 1)] + at
            below = inside & (self.keys[place] < key)
            lo, hi = np.where(below, middle + 1, lo), np.where(inside & ~below, middle, hi)
        return lo


def _item_block(rows: list[tuple[str, str]], window: int) -> tuple:
    hashes, bounds = W.word_hashes([text.encode().translate(W._LOWER) for _, text in rows], W.ALNUM)
    return [name for name, _ in rows], hashes, bounds, window


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, item, text) as a stored table of blocks of about ``ITEM_BLOCK_BYTES``, and how many there are."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BLOCK_BYTES))
    return stored(rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int").alias("block"), "item", "text"), "items"), blocks


class Shard:
    """Words of some texts with their suffix array."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, depth: int):
        self.bounds = bounds
        self.vocabulary, ranks = np.unique(hashes, return_inverse=True)
        counts = np.diff(bounds)
        # A 0 after every text keeps windows inside it.
        self.starts = bounds[:-1] + np.arange(len(counts))
        line = np.zeros(len(hashes) + len(counts), dtype=np.int64)
        line[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = ranks + 1
        self.array = SuffixArray(line, len(self.vocabulary), depth)

    def matches(self, block: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of every window of the block's items its places: (item row, place in words, window length, words of the longest match there)."""
        _, wanted, item_bounds, window = block
        sizes = np.diff(item_bounds)
        lengths = np.repeat(np.minimum(window, sizes), sizes)
        item = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(self.vocabulary, wanted), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[at] == wanted, at + 1, 0)
        first = np.arange(len(wanted))
        gaps = np.concatenate(([0], np.cumsum(known == 0)))
        whole = first + lengths <= np.repeat(item_bounds[1:], sizes)
        whole[whole] &= gaps[first[whole] + lengths[whole]] == gaps[first[whole]]
        first, lengths, item = first[whole], lengths[whole], item[whole]
        if not len(first):
            return
        reach = np.arange(window)
        table = np.where(reach < lengths[:, None], known[np.minimum(first[:, None] + reach, len(known) - 1)], 0)
        lo, hi = self.array.ranges(table)
        found = hi > lo
        first, lengths, item, lo, times = first[found], lengths[found], item[found], lo[found], (hi - lo)[found]
        # Whole items at a time, as a longer match runs over windows of one item.
        ends = np.append(np.flatnonzero(np.diff(item)) + 1, len(item)) if len(item) else np.empty(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(times)))
        begin = 0
        while begin < len(item):
            fits = ends[(ends > begin) & (upto[ends] - upto[begin] <= MATCHES)]
            end = fits[-1] if len(fits) else ends[ends > begin][0]
            part = slice(begin, end)
            n = times[part]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = self.array.order[np.repeat(lo[part], n) + offset]
            owner, start, size = np.repeat(item[part], n), np.repeat(first[part], n), np.repeat(lengths[part], n)
            # Windows that follow each other in the item and in the text are one match.
            turn = np.lexsort((place, place - start, owner))
            place, owner, start, size = place[turn], owner[turn], start[turn], size[turn]
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])
            run = np.cumsum(new) - 1
            longest = (np.bincount(run) - 1)[run] + size
            text = np.searchsorted(self.starts, place, "right") - 1
            yield owner, place - self.starts[text] + self.bounds[:-1][text], size, longest
            begin = end


def _pass(blocks: list, depth: int, last: bool):
    """Some blocks of items against all documents; spans and items of earlier passes are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in W.blocks(batch.column(1), block_bytes=SHARD_BYTES):
                rows = len(texts)
                before = batch.slice(begin, rows)
                hashes, bounds = W.word_hashes(texts, W.ALNUM)
                edges = np.zeros(len(hashes) + 1, dtype=np.int64)
                longest = np.array(before.column(5).to_pylist(), dtype=np.int64)
                items = [set(x) for x in before.column(4).to_pylist()]
                for k, spans in enumerate(before.column(3).to_pylist()):
                    np.add.at(edges, bounds[k] + np.array(spans[0::2], np.int64), 1)
                    np.add.at(edges, bounds[k] + np.array(spans[1::2], np.int64), -1)
                if blocks and len(hashes):
                    shard = Shard(hashes, bounds, depth)
                    for block in blocks:
                        names = block.value[0]
                        for item, places, length, runs in shard.matches(block.value):
                            np.add.at(edges, places, 1)
                            np.add.at(edges, places + length, -1)
                            owner = np.searchsorted(bounds, places, "right") - 1
                            np.maximum.at(longest, owner, runs)
                            for pair in np.unique(owner * len(names) + item):
                                name = names[pair % len(names)]
                                if name is not None:
                                    items[pair // len(names)].add(name)
                hit = np.cumsum(edges)[:-1] > 0
                spans = []
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    part = hit[lo:hi]
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], part, [False]))))
                    spans.append(turns.tolist())
                columns = [before.column(0)] + ([] if last else [before.column(1)]) + [
                    pa.array(np.diff(bounds), pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest)]
                yield pa.RecordBatch.from_arrays(columns, names=["id"] + ([] if last else ["text"]) + ["n_words", "spans", "items", "longest"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document row: id, ``n_words``, ``spans``, ``items``, ``longest``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is
    ``window`` consecutive words of an item; a shorter item with words is one window. ``spans`` are
    the hit word ranges of the document (start, end, start, end …), ``items`` the sorted ids of items
    with an occurring window and ``longest`` the words of the longest verbatim match. NULL and empty
    texts have no words and no hits; items without words or with NULL text match nothing, an item
    with a NULL id hits words but is not listed. Repeated rows each return a row; other columns
    are ignored.
    """
    empty = "array()"
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.expr(f"cast({empty} as array<long>)").alias("spans"),
                        F.expr(f"cast({empty} as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"))
    kind = docs.schema[id_col].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    table, blocks = item_blocks(benchmark, item_id_col, item_text_col)
    for at in range(0, blocks, PASS_BLOCKS):
        rows: dict[int, list] = {}
        for r in table.filter(F.col("block").between(at, at + PASS_BLOCKS - 1)).collect():
            rows.setdefault(r["block"], []).append((r["item"], r["text"]))
        shared = [context.broadcast(_item_block(x, window)) for x in rows.values()]
        last = at + PASS_BLOCKS >= blocks
        found = state.mapInArrow(_pass(shared, window, last), f"id {kind}, {'' if last else 'text string, '}{_STATE}")
        if last:
            state = found
        else:
            before, state = state, stored(found, "contamination")
            discard(before)
            for b in shared:
                b.destroy()
    discard(table)
    return state.withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``contamination``."""
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("k")),
                      lambda a, x: F.struct((a.s + x * a.k).alias("s"), (-a.k).alias("k")), lambda a: a.s)
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
                        F.col("longest").alias("longest_match"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents without any hit word; columns as given. Rows with a NULL id stay only if their text is clean."""
    # The given columns travel as one, so that none of their names meets one of these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("_row"))
    found = contamination(rows.select("_row", F.col("row")[text_col].alias("text")), benchmark, "_row", "text", **options)
    gone = stored(found.filter(F.size("spans") > 0).select(F.col("_row.i").alias("_i"), F.col("_row.h").alias("_h")).distinct(), "gone")
    kept = rows.join(gone, F.col("_row.i").eqNullSafe(F.col("_i")) & (F.col("_row.h") == F.col("_h")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
