"""The test tables read as an upstream world: orders are records, events are changes to them.

30 days of events are pressed into 28,800 seconds. Which record a change hits, its kind, its stamp
and the fate of its webhook are draws keyed by the change's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw

#: 2024-01-01 in microseconds, the time scale, the horizon and the poll interval.
EPOCH_US, SCALE, HORIZON, INTERVAL = 1_704_067_200_000_000, 90, 28_800.0, 300.0
#: Upper bounds in percent of the kinds of change.
MIX = {"UPDATE": 60, "SILENT_UPDATE": 68, "IN_FLIGHT_UPDATE": 78, "LATE_CLOCK_UPDATE": 85, "DELETE": 96, "MERGE": 100}
CLOCK_SKEW, BACKDATE, SPREAD = 11.0, 120, 864_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owner, stage, amount, last_modified): one live record, version 1, per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderstatus").alias("stage"),
        F.col("o_totalprice").alias("amount"), (-(draw("lm", "o_orderkey") % SPREAD)).cast("double").alias("last_modified"),
    )


def _kind(percent: Column) -> Column:
    out = None
    for kind, bound in MIX.items():
        out = F.when(percent < bound, kind) if out is None else out.when(percent < bound, kind)
    return out


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_at, kind, record_id, stamp, merged_into, death): the complete log of changes.

    A record's changes end with its first DELETE or MERGE, whose number is ``death``; what would hit
    it later is redirected to another record as a plain update. A merge into itself is an update.
    stamp is null where the record keeps the one it has.
    """
    drawn = _drawn(spark, sf_dir)
    kept = drawn.where("death is null or seq <= death")
    at = F.col("event_at")
    stamp = (
        F.when(F.col("kind") == "UPDATE", at)
        .when(F.col("kind") == "IN_FLIGHT_UPDATE", at - (draw("bk", "seq") % BACKDATE).cast("double"))
        .when(F.col("kind") == "LATE_CLOCK_UPDATE", at - CLOCK_SKEW)
    )
    own = kept.select("seq", "event_at", "kind", "record_id", stamp.alias("stamp"), F.when(F.col("kind") == "MERGE", F.col("partner")).alias("merged_into"), "death")
    moved = _moved(drawn).select(
        "seq", "event_at", F.lit("UPDATE").alias("kind"), F.col("moved_to").alias("record_id"), at.alias("stamp"), F.lit(None).cast("long").alias("merged_into"), F.col("died").alias("death"))
    return own.unionByName(moved)


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_at, record_id, moved_to): the changes that hit a record after its death, as plain
    updates of another one; those whose other record is dead by then too are dropped."""
    return _moved(_drawn(spark, sf_dir)).select("seq", "event_at", "record_id", "moved_to")


def _moved(rows: DataFrame) -> DataFrame:
    moved = F.col("low") + (F.col("seq") * 7 + F.col("record_id")) % F.col("n")
    late = rows.where("seq > death").select("seq", "event_at", "record_id", moved.alias("moved_to"))
    deaths = rows.where("seq = death").select(F.col("record_id").alias("moved_to"), F.col("death").alias("died"))
    return late.join(deaths, "moved_to", "left").where("died is null or seq < died")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn change with death, the number of its record's first fatal one."""
    size = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))
    raw = table(spark, sf_dir, "events").crossJoin(F.broadcast(size)).select(
        (F.col("event_id") + 1).alias("seq"), "n", "low",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(1e6) / SCALE).alias("event_at"),
    )
    raw = raw.select(
        "seq", "event_at", _kind(draw("k", "seq") % 100).alias("kind"),
        (F.col("low") + draw("r1", "seq") % (1 + draw("r2", "seq") % F.col("n"))).alias("record_id"),
        (F.col("low") + draw("mg", "seq") % F.col("n")).alias("partner"), "n", "low",
    )
    own = (F.col("kind") == "MERGE") & (F.col("partner") == F.col("record_id"))
    raw = raw.withColumn("kind", F.when(own, "UPDATE").otherwise(F.col("kind")))
    fatal = F.col("kind").isin("DELETE", "MERGE")
    death = F.min(F.when(fatal, F.col("seq"))).over(Window.partitionBy("record_id"))
    return raw.withColumn("death", death)


#: The fields that a change may set.
FIELDS = ("name", "owner", "stage", "amount", "region")


def field_changes(changes: DataFrame) -> DataFrame:
    """(seq, record_id, field, value): the field that each update sets, picked by a draw, and its
    drawn value as text."""
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (draw("fd", "seq") % len(FIELDS) + 1).cast("int"))
    return changes.where("kind not in ('DELETE', 'MERGE')").select("seq", "record_id", field.alias("field"), (draw("fv", "seq") % 1000).cast("string").alias("value"))


def effects(changes: DataFrame, archive: bool = False) -> DataFrame:
    """(id, seq, event_at, stamp, bump, kill): what the log does to records; a merge also modifies
    its survivor, if that is still alive. archive: a deleted record stays, archived, and its stamp
    moves to the deletion."""
    update = ~F.col("kind").isin("DELETE", "MERGE")
    stamp = F.when(~update, F.col("event_at")).otherwise(F.col("stamp")) if archive else F.col("stamp")
    own = changes.select(F.col("record_id").alias("id"), "seq", "event_at", stamp.alias("stamp"), F.when(update, 1).otherwise(0).alias("bump"), (~update).alias("kill"))
    deaths = changes.where("seq = death").select(F.col("record_id").alias("merged_into"), F.col("death").alias("died"))
    merges = changes.where("kind = 'MERGE'").select("merged_into", "seq", "event_at").join(deaths, "merged_into", "left")
    absorbed = merges.where("died is null or seq < died").select(
        F.col("merged_into").alias("id"), "seq", "event_at", F.col("event_at").alias("stamp"), F.lit(1).alias("bump"), F.lit(False).alias("kill"))
    return own.unionByName(absorbed)


def versions(recs: DataFrame, changes: DataFrame, archive: bool = False) -> DataFrame:
    """(id, seq, valid_from, valid_to, version, last_modified, tombstone): every state of every
    record; the first is valid from -1, the last one's valid_to is null."""
    start = recs.select("id", F.lit(0).cast("long").alias("seq"), F.lit(-1.0).alias("event_at"), F.col("last_modified").alias("stamp"), F.lit(0).alias("bump"), F.lit(False).alias("kill"))
    w = Window.partitionBy("id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return start.unionByName(effects(changes, archive)).select(
        "id", "seq", F.col("event_at").alias("valid_from"), F.lead("event_at").over(w).alias("valid_to"),
        (1 + F.sum("bump").over(so_far)).cast("long").alias("version"), F.max("stamp").over(so_far).alias("last_modified"), F.col("kill").alias("tombstone"))
