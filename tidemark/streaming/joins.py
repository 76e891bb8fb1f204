"""Joins of streams: changes with the hints that follow them, hints with what a record then is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hinted(changes: DataFrame, hints: DataFrame, within: str, lateness: str) -> DataFrame:
    """changes (seq, record_id, changed) with hinted, each hint (record_id, hinted) of the record
    that comes at or up to ``within`` after the change; null once none can come any more.

    Both sides have watermarks, so that state holds rows of that time only.
    """
    left = changes.withWatermark("changed", lateness)
    right = hints.select(F.col("record_id").alias("hint_of"), "hinted").withWatermark("hinted", lateness)
    near = F.expr(f"record_id = hint_of and hinted >= changed and hinted <= changed + interval {within}")
    return left.join(right, near, "left_outer").drop("hint_of")


def reread(hints: DataFrame, versions: DataFrame) -> DataFrame:
    """Each hint (record_id, arrival) with the version of its record that holds at its arrival, as a
    read of the record then gives it: a stream joined with a table."""
    held = versions.select(F.col("id").alias("record_id"), "version", "tombstone", "valid_from", "valid_to")
    both = hints.join(held, "record_id").where("valid_from <= arrival and (valid_to is null or arrival < valid_to)")
    return both.drop("valid_from", "valid_to")
