"""Connected components by repeated contraction; no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landtally.llm.store import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) → (node, component): the least node reachable, for every node that has an edge.

    Each round every node joins the least node of its closed neighbourhood and the edges are
    rewritten between the joined nodes. Node numbers must be hash-like: then the number of nodes
    falls by a factor each round, also along paths. NULL ends and loops are ignored.
    """
    step = edges.filter("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    step = stored(step, "edges")
    found = None
    while not step.isEmpty():
        both = step.union(step.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("_low")).select(
            F.col("a").alias("node"), F.least("a", "_low").alias("parent")), "edges")
        last, step = step, stored(
            step.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("_a")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("parent").alias("_b")), "b")
            .filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        up = parent.select(F.col("node").alias("component"), F.col("parent").alias("_up"))
        before = found
        found = stored((parent.select("node", F.col("parent").alias("component")) if found is None else
                        found.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))), "edges")
        discard(last, parent, before)
    if found is None:
        return step.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # The names of contracted nodes are least nodes of neighbourhoods, not yet of the component.
    least = found.groupBy("component").agg(F.min("node").alias("_least"))
    named = stored(found.join(least, "component").select("node", F.col("_least").alias("component")), "components")
    discard(step, found)
    return named
