"""Ordered digests of whole tables as trees over ranges of keys, and reconciliation by descent.

A leaf digests the rows of LEAF consecutive keys in key order, an inner node its children in order:
no task holds more than a leaf's rows or a node's children, and a root depends on the order of all
rows. Two trees over the same ranges differ exactly along the paths to ranges that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, FANOUT, LEVELS = 256, 16, 8


def _ordered(order: str, digest: str) -> Column:
    listed = F.sort_array(F.collect_list(F.struct(order, digest)))
    return F.sha2(F.concat_ws("", F.transform(listed, lambda x: x[digest])), 256)


def tree(rows: DataFrame, key: str, fields: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, n, digest): nodes of a table whose keys are whole numbers from 0 to LEAF *
    FANOUT ** levels; level ``levels`` has the one root. Fields are taken as text, nulls apart from
    empty ones; equal keys go by their digests."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in (key, *fields)))
    node = F.floor(F.col(key) / LEAF).cast("long")
    each = rows.select(node.alias("node"), F.col(key).alias("at"), F.sha2(text, 256).alias("digest"))
    level = each.groupBy("node").agg(F.count("*").alias("n"), _ordered("at", "digest").alias("digest"))
    out = [level.select(F.lit(0).alias("level"), "node", "n", "digest")]
    for k in range(1, levels + 1):
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.sum("n").alias("n"), _ordered("node", "digest").alias("digest")).withColumnRenamed("up", "node")
        out.append(level.select(F.lit(k).alias("level"), "node", "n", "digest"))
    return reduce(DataFrame.unionByName, out)


def descent(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, node, differs) of the nodes that a comparison of two trees asks for: the root, and
    the children of nodes that differ."""
    both = left.select("level", "node", F.col("digest").alias("a")).join(right.select("level", "node", F.col("digest").alias("b")), ["level", "node"], "full_outer")
    each = both.select("level", "node", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))
    parents = each.where("differs").select((F.col("level") - 1).alias("level"), F.col("node").alias("up"))
    asked = each.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(parents, ["level", "up"], "left_semi")
    return asked.select("level", "node", "differs").union(each.where(F.col("level") == levels))
