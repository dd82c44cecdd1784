"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt into chunks of bounded size. Order by order, a chunk sends every distinct n-gram once, sorted and
packed by hash partition; a partition adds up the counts of all chunks, which are the count
table of its share of the n-grams, and joins them back to the chunks that asked. There the n-grams
of every position are scored, less what their own document counts, and summed per document. A frequent n-gram costs a partition one
entry per chunk, whatever its count. No count and no score passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landtally.llm import words as W
from landtally.llm.store import discard, stored

#: Bytes of text of a chunk at most (one longer document is a chunk), and n-grams of one order in a partition on average.
CHUNK_BYTES = 8 << 20
PARTITION_GRAMS = 3_000_000
#: Weight of each step back, and the lowest order's count of words that are in no table.
BACKOFF, UNSEEN = 0.4, 0.5


def _pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that equal high bytes compress away."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


class Chunk:
    """Word numbers of a run of documents; rebuilt alike on both sides of the count join."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, order: int):
        self.words, self.counts, self.order = words, counts, order
        self.owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams inside documents and the position of each one's last word."""
        hashes = W.gram_hashes(self.words, n)
        last = np.arange(n - 1, n - 1 + len(hashes))
        inside = self.owner[last] == self.owner[last - n + 1] if len(hashes) else np.empty(0, bool)
        return hashes[inside], last[inside]

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes and their counts."""
        return np.unique(self.grams(n)[0], return_counts=True)

    def own(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For every n-gram how often its own document holds it."""
        owner = self.owner[last]
        turn = np.lexsort((hashes, owner))
        new = np.ones(len(turn), bool)
        new[1:] = (hashes[turn][1:] != hashes[turn][:-1]) | (owner[turn][1:] != owner[turn][:-1])
        run = np.cumsum(new) - 1
        out = np.empty(len(turn), np.int64)
        out[turn] = np.bincount(run)[run] if len(run) else 0
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to word sequences: ids, word counts, and the words as codes of the chunk's own dictionary."""
    for batch in batches:
        for begin, texts in W.blocks(batch.column(1), block_bytes=CHUNK_BYTES):
            parts, counts, at = [], [], 0
            while at < len(texts):  # word hashing in blocks that stay in the cache
                size, to = 0, at
                while to < len(texts) and (size == 0 or size < W.BLOCK_BYTES):
                    size += len(texts[to]) + 1
                    to += 1
                hashes, bounds = W.word_hashes(texts[at:to], W.SPACED)
                parts.append(hashes)
                counts.append(np.diff(bounds))
                at = to
            dictionary, codes = np.unique(np.concatenate(parts), return_inverse=True)
            counts = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0).slice(begin, len(texts)).to_pylist()], pa.list_(batch.column(0).type)),
                pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([len(codes)], pa.int64()), pa.array([len(dictionary)], pa.int64()),
                pa.array([_pack(np.diff(dictionary, prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(codes.astype(np.uint32))], pa.binary())],
                names=["ids", "counts", "n_words", "n_dict", "dict", "codes"])


def _words_of(row: dict) -> np.ndarray:
    dictionary = np.cumsum(_unpack(row["dict"], row["n_dict"], np.uint64), dtype=np.uint64)
    return dictionary[_unpack(row["codes"], row["n_words"], np.uint32)] if row["n_words"] else np.empty(0, np.uint64)


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """First index of each partition's stretch of sorted hashes."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _ask(n: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = Chunk(_words_of(row), np.array(row["counts"], dtype=np.int64), n).distinct(n)
                cut = _share(hashes, parts)
                out = [(p, row["chunk"], b - a, _pack(np.diff(hashes[a:b], prepend=np.uint64(0))), _pack(counts[a:b].astype(np.uint32)))
                       for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ASK, strict=True)], names=list(_ASK_NAMES)) if out else _EMPTY
    return run


_ASK = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_ASK_NAMES = ("part", "chunk", "n", "hashes", "counts")
_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in _ASK], names=list(_ASK_NAMES))


def _answer(table: pa.Table) -> pa.Table:
    """Counts of one hash partition over all chunks."""
    column = {c: table.column(c).to_pylist() for c in _ASK_NAMES}
    hashes = np.concatenate([np.cumsum(_unpack(h, n, np.uint64), dtype=np.uint64) for h, n in zip(column["hashes"], column["n"])])
    counts = np.concatenate([_unpack(c, n, np.uint32) for c, n in zip(column["counts"], column["n"])])
    distinct, where = np.unique(hashes, return_inverse=True)
    del hashes
    back = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.uint64)[where]
    at = np.cumsum([0, *column["n"]])
    return pa.table({"chunk": pa.array(column["chunk"], pa.int64()), "part": pa.array(column["part"], pa.int64()), "n": pa.array(column["n"], pa.int64()),
                     "found": pa.array([_pack(back[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def _score(order: int, corpus_words: int, ids: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_ids, n_words, seen, scores = [], [], [], []
        for row in left.to_pylist():
            counts = np.array(row["counts"], dtype=np.int64)
            chunk = Chunk(_words_of(row), counts, order)
            answers = sorted(right.to_pylist(), key=lambda r: r["part"])
            # The corpus of a document is what all others hold.
            others = np.maximum(1.0, corpus_words - counts.astype(np.float64))[chunk.owner]
            best = np.log(UNSEEN / others) + (order - 1) * np.log(BACKOFF)
            hit = np.zeros(len(chunk.words), np.int64)
            lower = np.zeros(0)
            for n in range(1, order + 1):
                hashes, last = chunk.grams(n)
                distinct = np.unique(hashes)
                mine = [r for r in answers if r["grams"] == n]
                table = np.concatenate([_unpack(r["found"], r["n"], np.uint64) for r in mine]).astype(np.float64) if mine else np.zeros(0)
                count = table[np.searchsorted(distinct, hashes)] - chunk.own(hashes, last)
                here = np.zeros(len(chunk.words))
                here[last] = count
                # The context of an n-gram is the (n-1)-gram that ends one word earlier.
                context = others[last] if n == 1 else lower[last - 1]
                good = count > 0
                best[last[good]] = np.log(count[good] / context[good]) + (order - n) * np.log(BACKOFF)
                hit[last[good]] = n
                lower = here
            # A document's first words have no longer n-gram: they are not punished for it.
            place = np.arange(len(chunk.words)) - np.repeat(np.cumsum(counts) - counts, counts)
            best += np.log(1 / BACKOFF) * np.maximum(order - 1 - place, 0)
            total = np.bincount(chunk.owner, weights=best, minlength=len(counts))
            out_ids += row["ids"]
            n_words += counts.tolist()
            seen += np.bincount(chunk.owner, weights=hit == order, minlength=len(counts)).astype(np.int64).tolist()
            scores += total.tolist()
        return pa.table({"id": pa.array(out_ids, ids), "n_words": pa.array(n_words, pa.int64()), "n_full": pa.array(seen, pa.int64()),
                         "score": pa.array(scores, pa.float64())})
    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """One row per document row: id, ``n_words``, ``n_full``, ``score``, ``mean_score``.

    Words stand between white space, A-Z lower-cased. A document is scored by the counts of all others: the n-grams of the whole
    corpus less its own. A word scores the log of count over context count at the highest order that others
    hold, and log 0.4 for every order stepped back; a word that no other document holds counts as half a place. ``n_full`` words are found at full
    order. NULL and empty texts have no words and score 0, with a NULL mean. Repeated rows are documents of their own and
    return a row each; a NULL id is returned as it is; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = texts.mapInArrow(_chunks, f"ids array<{kind}>, counts array<long>, n_words long, n_dict long, dict binary, codes binary")
    chunks = stored(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, round(total / PARTITION_GRAMS))
    # One order after the other, so that the n-grams of one are all that is on its way at a time.
    answers = []
    for n in range(1, order + 1):
        asked = chunks.select("chunk", "counts", "n_words", "n_dict", "dict", "codes").mapInArrow(
            _ask(n, parts), "part long, chunk long, n long, hashes binary, counts binary")
        answered = asked.groupBy("part").applyInArrow(_answer, "chunk long, part long, n long, found binary")
        answers.append(stored(answered.withColumn("grams", F.lit(n)), "answers"))
    answered = reduce(DataFrame.union, answers)
    scored = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        _score(order, total, _arrow_type(texts)), f"id {kind}, n_words long, n_full long, score double")
    scored = stored(scored, "scores")
    discard(chunks, *answers)
    return scored.select(F.col("id").alias(id_col), "n_words", "n_full", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))


def _arrow_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(texts.schema["id"].dataType)
