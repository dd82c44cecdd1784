"""Near-duplicate vectors by exact comparison in blocks.

Equal vectors of a label are one node. The nodes of a label are dealt into blocks, and every pair of blocks
is compared once: this counts the links of every vector, and of the links found a pair of blocks returns only what
names the components, a row per vector at most, so that no pair table of a large group of copies is ever
made. No link is left to a list, a cell or a sample; the price is work that grows with the square of a label's
distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from landtally.llm.graph import components
from landtally.llm.store import stored
from landtally.session import spread

#: Rows of a block of the comparison, and of a block's product held at once.
BLOCK, STRIPE = 4096, 512


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x) of vectors that can link: labelled, not null, finite and not zero; x has length 1."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)).alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(~bad)
    # Scaled by the largest component first, so that no square overflows or vanishes.
    top = F.array_max(F.transform("x", F.abs))
    rows = rows.withColumn("_top", top).filter("_top > 0").withColumn("x", F.transform("x", lambda v: v / F.col("_top"))).drop("_top")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.withColumn("_norm", norm).withColumn("x", F.transform("x", lambda v: v / F.col("_norm"))).drop("_norm")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _batched(table: DataFrame, keys: list[str], rows: int = 4096) -> DataFrame:
    """``bin``: many small groups of equal keys together, so that a task is called once for thousands of rows."""
    n = table.count()
    return table.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(max(1, n // rows))))


def _groups(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each group of equal keys and equal vector length."""
    pdf = pdf.assign(_width=pdf["x"].map(len))
    for _, same in pdf.groupby("_width"):
        x = _matrix(same["x"])
        at = same.index.to_numpy()
        code = same.groupby(keys, sort=False).ngroup().to_numpy()
        turn = np.argsort(code, kind="stable")
        for rows in np.split(turn, np.flatnonzero(np.diff(code[turn])) + 1):
            yield at[rows], x[rows]


def _blocks(table: DataFrame) -> DataFrame:
    """Every pair of blocks of a label once: (label, lo, hi) with the rows of both sides; ``i`` is a row's own block."""
    sizes = table.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / BLOCK)).filter("_n > 1")
    dealt = table.join(sizes, "label").withColumn("i", F.pmod(F.xxhash64("node", F.lit(9)), F.col("_parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: F.struct(
        F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    return dealt.select("label", "i", "node", "m", "x", F.explode(pairs).alias("p")).select("label", "p.lo", "p.hi", "i", "node", "m", "x")


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of links without empty rows and columns: for each row a column, for each column a row of its component."""
    row_peer, col_peer = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for first in range(near.shape[0]):
        if row_peer[first] >= 0:
            continue
        peer = int(near[first].argmax())
        front = np.array([first])
        row_peer[front] = peer
        while len(front):
            cols = np.flatnonzero(near[front].any(axis=0) & (col_peer < 0))
            col_peer[cols] = first
            front = np.flatnonzero(near[:, cols].any(axis=1) & (row_peer < 0))
            row_peer[front] = peer
    return row_peer, col_peer


def _compared(table: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a label: (node, peer, links), the copies each node links with and a node of its component, per pair of blocks."""
    keys = ["label", "lo", "hi"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, m, block, lo, hi = (pdf[c].to_numpy() for c in ("node", "m", "i", "lo", "hi"))
        nodes, peers, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, x in _groups(pdf, keys):
            first, second = lo[rows[0]], hi[rows[0]]
            a, b = np.flatnonzero(block[rows] == first), np.flatnonzero(block[rows] == second)
            if not len(a) or not len(b):
                continue
            close = np.empty((len(a), len(b)), bool)
            for at in range(0, len(a), STRIPE):
                np.greater_equal(x[a[at:at + STRIPE]] @ x[b].T, threshold, out=close[at:at + STRIPE])
            if first == second:
                np.fill_diagonal(close, False)
            left, right = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            near = close[np.ix_(left, right)]
            left, right = rows[a[left]], rows[b[right]]
            row_peer, col_peer = _joined(near)
            nodes += [node[left], node[right]]
            peers += [node[right[row_peer]], node[left[col_peer]]]
            # Inside one block the columns are the rows once more.
            links += [near @ m[right], near.T @ m[left] if first != second else np.zeros(len(right), np.int64)]
        return pd.DataFrame({"node": np.concatenate(nodes), "peer": np.concatenate(peers), "links": np.concatenate(links)})

    # A fixed number of tasks: the rows are small in bytes but long in compute.
    return spread(_batched(_blocks(table), keys), "bin").groupBy("bin").applyInPandas(run, "node long, peer long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93) -> DataFrame:
    """One row per vector row: id, ``n_links``, ``component_id``, ``kept``, ``class_id``.

    Vectors of one label link at a cosine of ``threshold`` or more, in double precision. NULL and zero vectors,
    vectors with NULL or non-finite components and rows without a label link with nothing and are
    their own component. Vectors of different lengths do not link. Copies count as links of each other. Repeated rows count each; a
    NULL id takes part, and its row is kept only if no row of its component has an id. Other columns are ignored.
    """
    rows = stored(_usable(vectors, id_col, vector_col, label_col).withColumn("node", F.xxhash64("label", "x")), "vectors")
    nodes = stored(rows.groupBy("node").agg(F.min("label").alias("label"), F.min("id").alias("low"), F.count(F.lit(1)).alias("m"),
                                            F.first("x").alias("x")), "vectors")
    compared = stored(_compared(nodes.select("label", "node", "m", "x"), threshold), "vectors")
    belongs = components(compared.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "low", "m").join(belongs, "node", "left").join(counts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("node", F.col("low").alias("class_id"), "component_id",
                                                  (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    usable = rows.select("id", "node").join(named, "node").select("id", "n_links", "component_id", "class_id")
    rest = _others(vectors, id_col, vector_col, label_col)
    out = usable.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull()).alias("kept"), "class_id")


def _others(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that link with nothing."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.col(label_col).isNull() | F.col(vector_col).isNull() | (F.size(vector_col) == 0) | F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    return vectors.filter(F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"),
        F.col(id_col).cast("long").alias("class_id"))
