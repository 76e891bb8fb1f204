"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest id reachable.

    Each round every node takes its smallest neighbour or itself as its label, then that label's
    label until none moves; edges are redrawn between labels and those inside one label go, so that
    a dense group's edges are gone after a round and the labels left at least halve in each. Tables between rounds are written to the shared folder:
    a hub's edges meet its one label in a join of two plain exchanges, which AQE splits.
    """
    drawn = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    out = None
    for _ in range(rounds):
        if drawn.isEmpty() and out is not None:
            return out.select("node", F.col("label").alias("component"))
        both = drawn.union(drawn.select("b", "a")).toDF("node", "near")
        first = both.groupBy("node").agg(F.min("near").alias("near"))
        first = materialize(first.select("node", F.least("node", "near").alias("label")), "labels")
        labels, moved = first, True
        while moved:
            up = labels.toDF("label", "up")
            jumped = labels.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved"))
            jumped = materialize(jumped, "labels")
            labels, moved = jumped.select("node", "label"), not jumped.where("moved").isEmpty()
        a, b = labels.toDF("a", "x"), labels.toDF("b", "y")
        ends = drawn.join(a, "a").join(b, "b").where("x <> y")
        drawn = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if out is None:
            out = labels
        else:
            up = labels.toDF("label", "up")
            out = materialize(out.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "components")
    raise RuntimeError(f"links are left after {rounds} rounds")
