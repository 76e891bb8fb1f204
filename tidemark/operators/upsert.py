"""Idempotent versioned upserts: last write wins unless an older version comes, deletions are marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted(writes: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """writes that a store takes in ``order``: those not older than what it holds; equal ones overwrite."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(version).over(before)
    return writes.withColumn("__held", held).where(F.col("__held").isNull() | (F.col(version) >= F.col("__held"))).drop("__held")


def counters(log: DataFrame, key: str, version: str, order: str, mark: str) -> DataFrame:
    """One row with what a store has counted over a log of versioned upserts and delete marks:
    upserts, rejected and redundant ones (the version already held), and delete marks that hit a
    held key which was not marked."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    write = ~F.col(mark)
    held = F.max(F.when(write, F.col(version))).over(before)
    taken = write & (held.isNull() | (F.col(version) >= held))
    each = log.select(key, order, mark, held.alias("held"), taken.alias("taken"), (write & (held == F.col(version))).alias("redundant"))
    last = F.last(F.when(F.col("taken"), False).when(F.col(mark), True), ignorenulls=True).over(before)
    each = each.withColumn("was", F.coalesce(last, F.lit(False)))
    return each.agg(
        F.count_if(~F.col(mark)).alias("upserts"), F.count_if(~F.col(mark) & ~F.col("taken")).alias("rejected"), F.count_if("redundant").alias("redundant"),
        F.count_if(F.col(mark) & F.col("held").isNotNull() & ~F.col("was")).alias("delete_marks"))


def unversioned(log: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """(key, version) of a store that takes whatever comes last."""
    return log.groupBy(key).agg(F.max_by(version, order).alias(version))


def apply_log(log: DataFrame, key: str, version: str, order: str, mark: str) -> DataFrame:
    """(key, version, deleted) after a log of upserts and delete marks (rows where ``mark`` is true).

    An accepted upsert clears a mark, a rejected one doesn't; a key that was only marked is not held.
    """
    writes = accepted(log.where(~F.col(mark)), key, version, order)
    last = writes.groupBy(key).agg(F.max(version).alias(version), F.max(order).alias("__written"))
    marks = log.where(F.col(mark)).groupBy(key).agg(F.max(order).alias("__marked"))
    return last.join(marks, key, "left").select(key, version, F.coalesce(F.col("__marked") > F.col("__written"), F.lit(False)).alias("deleted"))
