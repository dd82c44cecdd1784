"""Quality filter by importance resampling.

Two hashed n-gram models are counted: one of the target (documents labelled good and not toxic) and
one of the raw text (all documents). A document's log importance weight sums the log ratios
of its distinct n-grams that speak against the target; documents are drawn by Gumbel top-k on
these weights, with k the number of documents above the weight that best parts the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from landtally.llm import words as W
from landtally.llm.store import stored

#: Hash buckets of the models; they bound what reaches the driver and the executors.
BUCKETS = 1 << 20
SLICES = 256
#: Labelled documents, chosen by hash, that define the target and the cut at most.
LABELLED = 200_000
#: Smoothing in documents, and how far a ratio must fall before it counts: rare n-grams differ by chance.
SMOOTH, MARGIN = 3.0, 1.0
#: The noise is small against the evidence of one telling n-gram, so that the draw decides near the cut only.
TEMPERATURE = 0.01
#: Share of the good documents of the cut's half that must stay.
KEEP = 0.99


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct unigrams, bigrams and immediate repetitions of each text."""
    hashes, bounds = W.word_hashes(texts, W.KINDS)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    mask = np.uint64(BUCKETS - 1)
    keys = [(owner << 20) | (hashes & mask).astype(np.int64)]
    if len(hashes) > 1:
        pairs = W.gram_hashes(hashes, 2)
        keys.append(((owner[:-1] << 20) | (pairs & mask).astype(np.int64))[owner[:-1] == owner[1:]])
    if len(hashes) > 4:
        again = (hashes[:-2] == hashes[1:-1]) & (hashes[1:-1] == hashes[2:]) & (owner[:-2] == owner[2:])
        keys.append((owner[:-2][again] << 20) | 1)
        twice = (hashes[:-4] == hashes[2:-2]) & (hashes[2:-2] == hashes[4:]) & (hashes[1:-3] == hashes[3:-1]) & (owner[:-4] == owner[4:])
        keys.append((owner[:-4][twice] << 20) | 2)
    both = np.unique(np.concatenate(keys))
    return both >> 20, both & (BUCKETS - 1)


def _count(labels: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = labels.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in W.blocks(batch.column(1), lower=False):
                owner, bucket = buckets(texts)
                chosen = np.fromiter((good.get(i) == 1 for i in ids[begin:begin + len(texts)]), bool, len(texts))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        yield _slices(np.stack((raw, target)))
    return run


def _slices(table: np.ndarray) -> pa.RecordBatch:
    parts = table.reshape(2, SLICES, -1)
    filled = [k for k in range(SLICES) if parts[0, k].any()]
    packed = [pa.compress(np.ascontiguousarray(parts[:, k]).tobytes(), codec="zstd", asbytes=True) for k in filled]
    return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice over all tasks; one array per slice is held."""
    size = 2 * (BUCKETS // SLICES)
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(packed, decompressed_size=size * 8, codec="zstd", asbytes=True), np.int64)
            held[k] = held[k] + part if k in held else part
    for k, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])


def _weigh(evidence: Broadcast, names: list[str]):
    """Adds ``log_weight`` to rows whose last column is the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = evidence.value
        for batch in batches:
            for begin, texts in W.blocks(batch.column(batch.num_columns - 1), lower=False):
                owner, bucket = buckets(texts)
                weight = np.bincount(owner, weights=table[bucket], minlength=len(texts))
                rows = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(names)], pa.array(weight.astype(np.float64), pa.float64())], names=[*names, "log_weight"])
    return run


@dataclass
class Model:
    """``evidence`` per bucket (at most 0) and the least perturbed weight of a drawn document."""

    evidence: Broadcast
    cut: float


def _perturbed(id_col: str, text_col: str, temperature: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), 12) + 0.5) / float(1 << 52)
    return F.lit(-temperature) * F.log(-F.log(unit))


def _kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of at most 1,024 bins that close in on it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / 1024
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(1023)) if width > 0 else F.lit(0)
        inside = rows.filter(F.col(column).between(low, high))
        bins = sorted(inside.groupBy(bin_of.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["b"])
        for r in bins:
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        if len(bins) == 1:
            break
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        toxic_col: str = "toxic", labelled: int = LABELLED, temperature: float = TEMPERATURE) -> Model:
    """Count both models over all documents, weigh all documents and find the cut.

    Labels with NULL ids are ignored, a missing label counts against the document, and of repeated labels the worst
    counts. Where the labels are all of one kind, or there are no documents, nothing is rejected.
    """
    context = docs.sparkSession.sparkContext
    good = F.min(F.when((F.col(quality_col) == 1) & (F.col(toxic_col) == 0), 1).otherwise(0)).alias("good")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(good)
    n = known.count()
    part = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, labelled / max(1, n))))
    # One half of the labelled documents makes the target, the other half finds the cut: a document that
    # helped to make the target says nothing about how well others are told apart.
    part = part.withColumn("half", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)))
    rows = part.collect()
    label = context.broadcast({r["id"]: r["good"] for r in rows if r["half"] == 0})
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_count(label), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(
        _sum, "slice int, counts binary").collect()
    table = np.zeros((2, SLICES, BUCKETS // SLICES), np.int64)
    for row in counted:
        table[:, row["slice"]] = np.frombuffer(row["counts"], np.int64).reshape(2, -1)
    raw, target = table.reshape(2, -1).astype(np.float64)
    if not target.any() or min(r["good"] for r in rows) == 1:
        return Model(context.broadcast(np.zeros(BUCKETS)), float("-inf"))
    expected = raw * (target.sum() / raw.sum())
    evidence = context.broadcast(np.minimum(np.log((target + SMOOTH) / (expected + SMOOTH)) + MARGIN, 0.0))

    noise = docs.select(F.col(id_col).cast("long").alias("id"), _perturbed(id_col, text_col, temperature).alias("noise"),
                        F.col(text_col).cast("string").alias("text"))
    scored = stored(noise.mapInArrow(_weigh(evidence, ["id", "noise"]), "id long, noise double, log_weight double").withColumn(
        "key", F.col("log_weight") + F.col("noise")), "weights")
    sample = scored.join(F.broadcast(part.filter("half = 1")), "id").select("log_weight", "good").toPandas()
    line = _best_cut(sample["log_weight"].to_numpy(), sample["good"].to_numpy() == 1)
    k = scored.filter(F.col("log_weight") >= line).count()
    return Model(evidence, _kth_largest(scored, "key", k) if k else float("inf"))


def _best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on documents count as good: the best mean of both hit rates that keeps KEEP of the good."""
    if not good.any() or good.all():
        return float("-inf")
    values = np.unique(weight)
    kept_good = 1 - np.searchsorted(np.sort(weight[good]), values) / good.sum()
    cut_bad = np.searchsorted(np.sort(weight[~good]), values) / (~good).sum()
    return float(values[np.argmax(np.where(kept_good >= KEEP, kept_good + cut_bad, 0.0))])


def draw(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE,
         weight_col: str | None = None) -> DataFrame:
    """The drawn documents, columns as given and ``weight_col`` with the log weight if named.

    NULL and empty texts have weight 0 and stay if documents without evidence do. Ties at the cut, such as repeated
    rows, are all drawn.
    """
    names = [c for c in docs.columns if c != weight_col]
    rows = docs.select(F.struct(*names).alias("row"), _perturbed(id_col, text_col, temperature).alias("noise"),
                       F.col(text_col).cast("string").alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, noise double, log_weight double"
    drawn = rows.mapInArrow(_weigh(model.evidence, ["row", "noise"]), kinds).filter(F.col("log_weight") + F.col("noise") >= model.cut)
    return drawn.select(*[F.col("row")[c].alias(c) for c in names], *([F.col("log_weight").alias(weight_col)] if weight_col else []))
