"""When a change shows in the local copy: the first read of its record after it, by hint or by poll.

A webhook is a hint: its record is read again at the arrival, and then holds all changes up to
then; if it is gone, it is marked deleted. A poll reads records whose stamp meets its bound, and so
never a deleted one; of deletions it is told by the vendor's endpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_reads(changes: DataFrame, hooks: DataFrame, polls: DataFrame, tells: DataFrame) -> DataFrame:
    """changes (seq, kind, record_id, event_at and others) with hook_at and poll_at, the first time
    that hooks (record_id, at) and polls (record_id, at) read the record at or after the change; a
    deletion's or merge's poll_at is the first time that tells (record_id, at) names the record. If
    hooks have ``left``, left_at is the first time of those where it is true.

    One window per record over all of them in order of time, latest first, so that each row adds one
    read to what is known: no change meets a read in a join.
    """
    more = [c for c in changes.columns if c not in ("seq", "kind", "record_id", "event_at")]
    log = changes.select("record_id", F.col("event_at").alias("t"), F.lit(0).alias("what"), "seq", "kind", *more)
    names = ["hook", "poll", "tell", *["left"] * ("left" in hooks.columns)]
    for name, df in (("hook", hooks), ("poll", polls), ("tell", tells)):
        told = [F.when(F.col("left"), F.col("at")).alias("left")] if "left" in df.columns else []
        log = log.unionByName(df.select("record_id", F.col("at").alias("t"), F.lit(1).alias("what"), F.col("at").alias(name), *told), allowMissingColumns=True)
    later = Window.partitionBy("record_id").orderBy(F.desc("t"), F.desc("what")).rowsBetween(Window.unboundedPreceding, 0)
    seen = log.select("*", *(F.min(n).over(later).alias(f"{n}_at") for n in names)).where("what = 0")
    dead = F.col("kind").isin("DELETE", "MERGE")
    poll = F.when(dead, F.col("tell_at")).otherwise(F.col("poll_at")).alias("poll_at")
    return seen.select("seq", "kind", "record_id", F.col("t").alias("event_at"), "hook_at", poll, *(f"{n}_at" for n in names[3:]), *more)


def credited(reads: DataFrame, arms: DataFrame, horizon: float, *more: str) -> DataFrame:
    """(arm, seq, kind, latency, source) of each change under each of arms (arm, hook, poll): the
    earlier of the reads that the arm has, a hint first if both come at once; nulls if neither
    comes within the horizon. Of arms with ``outage`` true, left_at counts instead of hook_at.
    ``more`` names columns of reads to give too."""
    both = reads.crossJoin(F.broadcast(arms))
    hinted = F.when(F.col("outage"), F.col("left_at")).otherwise(F.col("hook_at")) if "outage" in arms.columns else F.col("hook_at")
    hook = F.when(F.col("hook") & (hinted <= horizon), hinted)
    poll = F.when(F.col("poll") & (F.col("poll_at") <= horizon), F.col("poll_at"))
    at = F.least(hook, poll)
    source = F.when(hook.isNotNull() & (hook == at), "webhook").when(at.isNotNull(), "poll")
    return both.select("arm", "seq", "kind", (at - F.col("event_at")).alias("latency"), source.alias("source"), *more)
