"""Connected components by random hooking and contraction; nothing but the test for an end reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): one root for each component of nodes that have an edge.

    Every round, each node hooks on to the neighbour with the least hash of (node, round) if that is less than its own,
    and the graph is contracted; that takes away a constant part of the nodes in expectation, whatever the graph's
    shape. Self-loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, n=len(steps): F.xxhash64(F.col(c), F.lit(n))
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        best = both.groupBy("node").agg(F.min_by("other", rank("other")).alias("other"))
        step = materialise(best.select("node", F.when(rank("other") < rank("node"), F.col("other")).otherwise(F.col("node")).alias("root")), "hooks")
        steps.append(step)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        before, edges = edges, materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(before)
    if not steps:
        return edges.toDF("node", "root")
    roots = steps.pop()
    while steps:
        later, step = roots, steps.pop()
        roots = materialise(step.join(later.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
        discard(later, step)
    return roots
