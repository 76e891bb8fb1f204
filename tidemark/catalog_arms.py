"""Registered queries that set arms side by side: deletions, channels, failures, stores, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw
from tidemark.functions.ranks import percentiles
from tidemark.operators import channel, detect, reconcile, report, scan, sync, upsert
from tidemark.plans.stage import new_path, written
from tidemark.sources import fixtures
from tidemark.sources.fixtures import HORIZON, INTERVAL, table
from tidemark.streaming import dedup

PASSES, OVERLAP, PAGE = 96, 120.0, 200
OUTAGE, DISABLE_AFTER = (7200.0, 10800.0), 25
RUNGS = [
    ("0 naive", 0.0, False, False), ("1 inclusive", 0.0, True, False), ("2 overlap_60", 60.0, True, False),
    ("3 overlap_300", 300.0, True, False), ("4 deletions", 300.0, True, True), ("5 deletions, outage", 300.0, True, True),
]
#: Fixed value: how long the deletes endpoint remembers. The passes in which it fails on the last rung are more than that.
RETENTION = 7200.0
SILENT = (25, 60)


def _changes(spark, sf):
    return written(fixtures.mutations(spark, sf), "changes")


def _versions(spark, sf, changes, archive=False):
    return written(fixtures.versions(fixtures.records(spark, sf), changes, archive), "versions")


def _arms(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "arm string, overlap double, inclusive boolean, deletes boolean")


def _one(spark):
    return _arms(spark, [("a", OVERLAP, True, False)])


def _deaths(changes):
    return changes.where("seq = death").select(F.col("record_id").alias("id"), F.col("event_at").alias("at"))


def _rungs(spark, sf):
    """The ladder of two vendors: one tells deletions by an endpoint that forgets, the other keeps
    archived rows in its scans, which count as live unless they are looked at. On the last rung the
    endpoint fails for longer than it remembers."""
    recs, changes, arms = fixtures.records(spark, sf), _changes(spark, sf), _arms(spark, RUNGS)
    failed = spark.range(SILENT[0], SILENT[1] + 1).select(F.lit(RUNGS[-1][0]).alias("arm"), F.col("id").cast("int").alias("pass_no"))
    out, truth = None, None
    for vendor in ("atlas", "beacon"):
        archive = vendor == "beacon"
        versions = _versions(spark, sf, changes, archive)
        truth = sync.truth_at(versions, HORIZON) if truth is None else truth
        if archive:
            read = sync.reads(versions, arms, INTERVAL, PASSES, True)
            gone = read.groupBy("arm", "id").agg(F.max_by("tombstone", "pass_no").alias("gone")).where("gone").select("arm", "id")
        else:
            read = sync.reads(versions, arms, INTERVAL, PASSES, False, failed)
            gone = sync.deletions_told(_deaths(changes), versions, arms.where("deletes"), INTERVAL, PASSES, RETENTION, failed)
        local = sync.without_deleted(sync.local_copy(recs, read, arms), arms, gone)
        one = sync.score(sync.compare(truth, local, arms)).select(F.lit(vendor).alias("vendor"), "arm", "stale", "missing", "ghost", "wrong")
        out = one if out is None else out.union(one)
    return out


def deletion_ladder(spark, sf):
    return _rungs(spark, sf)


def prediction_tally(spark, sf):
    """How often a rung has no more wrong records than the one before, as it should."""
    was = F.lag("wrong").over(Window.partitionBy("vendor").orderBy("arm"))
    each = _rungs(spark, sf).withColumn("was", was).where("was is not null")
    return each.groupBy(F.when(F.col("wrong") <= F.col("was"), "HELD").otherwise("REFUTED").alias("verdict")).agg(F.count("*").alias("n"))


def bar_chart_ghosts(spark, sf):
    return report.bars(_rungs(spark, sf).select(F.concat_ws(" ", "vendor", "arm").alias("label"), F.col("ghost").alias("n")), "label", "n", expected=2 * len(RUNGS))


def score_by_kind_arms(spark, sf):
    """Changes by kind, with and without the deletions asked for: a deletion is reflected if its
    record isn't held any more, another change if its record is correct."""
    changes = _changes(spark, sf)
    versions, arms = _versions(spark, sf, changes), _arms(spark, [("deletes", OVERLAP, True, True), ("plain", OVERLAP, True, False)])
    local = sync.local_copy(fixtures.records(spark, sf), sync.reads(versions, arms, INTERVAL, PASSES), arms)
    local = sync.without_deleted(local, arms, sync.deletions_told(_deaths(changes), versions, arms.where("deletes"), INTERVAL, PASSES, RETENTION))
    state = sync.compare(sync.truth_at(versions, HORIZON), local, arms).withColumnRenamed("id", "record_id")
    each = changes.crossJoin(F.broadcast(arms.select("arm"))).join(state, ["arm", "record_id"], "left")
    fatal, died = F.col("kind").isin("DELETE", "MERGE"), F.col("death").isNotNull()
    hit = F.when(fatal, F.col("state").isNull()).otherwise(~died & (F.col("state") == "correct"))
    miss = F.when(fatal, F.col("state").isNotNull()).otherwise(~died & (F.col("state") != "correct"))
    return each.groupBy("arm", "kind").agg(
        F.count("*").alias("happened"), F.count_if(hit).alias("reflected"), F.count_if(~fatal & died).alias("superseded"), F.count_if(miss).alias("missed"))


WAYS = [("poll", False, True, False), ("webhook", True, False, False), ("both", True, True, False), ("both_outage", True, True, True)]


class _Channels:
    """What polls, deletion calls and hints read of the log; in an outage, hints fail and then the
    subscription is disabled after enough failures in a row."""

    def __init__(self, spark, sf):
        self.spark, self.changes = spark, _changes(spark, sf)
        self.versions = _versions(spark, sf, self.changes)
        self.read = written(sync.reads(self.versions, _one(spark), INTERVAL, PASSES), "reads")
        told = sync.deletions_told(_deaths(self.changes), self.versions, _one(spark), INTERVAL, PASSES, RETENTION)
        at = lambda df: df.select(F.col("id").alias("record_id"), (F.col("pass_no") * F.lit(INTERVAL)).alias("at"))
        self.polls, self.tells = at(self.read), at(told)
        # each event's first delivery, how many there are, and whether the outage leaves it
        sent = channel.deliveries(self.changes).groupBy("event_id").agg(F.min(F.struct("arrival", "copy", "record_id", "seq")).alias("x"), F.count("*").alias("n"))
        runs = channel.failure_runs(self.changes, *OUTAGE)
        off = runs.where(F.col("down") & (F.col("run") == DISABLE_AFTER)).agg(F.min("seq").alias("off"))
        left = ~F.col("arrival").between(*OUTAGE) & (F.col("off").isNull() | (F.col("seq") < F.col("off")))
        sent = sent.select("x.*", "n").crossJoin(F.broadcast(off))
        self.sent = written(sent.select("record_id", F.col("arrival").alias("at"), "n", left.alias("left")), "sent")

    def credited(self, changes, *more):
        """(arm, seq, kind, latency, source) of changes for polls alone, webhooks alone, both, and
        both with the outage; ``more`` names columns of changes to give too."""
        arms = self.spark.createDataFrame(WAYS, "arm string, hook boolean, poll boolean, outage boolean")
        return detect.credited(detect.first_reads(changes, self.sent.drop("n"), self.polls, self.tells), arms, HORIZON, *more)

    def calls(self):
        """(arm, calls, absorbed): pages and deletion calls of the polls, one call a hint, and the
        deliveries that dedup takes out."""
        pages = self.read.groupBy("pass_no").agg(F.floor(F.count("*") / PAGE).alias("full")).agg(F.coalesce(F.sum("full"), F.lit(0)).alias("full"))
        sums = pages.select((F.col("full") + 2 * PASSES).alias("polls"))
        left = lambda c: F.coalesce(F.sum(F.when(F.col("left"), F.col(c))), F.lit(0))
        n = self.sent.withColumn("one", F.lit(1)).agg(
            F.count("*").alias("hints_False"), F.coalesce(F.sum("n"), F.lit(0)).alias("sent_False"), left("one").alias("hints_True"), left("n").alias("sent_True"))
        sums = sums.crossJoin(n)  # of one row each
        hint = lambda name, hook, outage: F.col(f"{name}_{outage}") if hook else F.lit(0)
        rows = [F.struct(F.lit(arm).alias("arm"), (F.col("polls") * int(poll) + hint("hints", hook, outage)).cast("long").alias("calls"),
                         (hint("sent", hook, outage) - hint("hints", hook, outage)).cast("long").alias("absorbed")) for arm, hook, poll, outage in WAYS]
        return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _credited(spark, sf):
    channels = _Channels(spark, sf)
    return written(channels.credited(channels.changes.select("seq", "kind", "record_id", "event_at")), "credited")


def channel_arms(spark, sf):
    """Per arm: changes detected and by what, latencies, records whose last change isn't in the copy
    at the end, calls, and duplicate deliveries absorbed."""
    channels = _Channels(spark, sf)
    last = scan.as_of(channels.versions, HORIZON).where("valid_from >= 0")
    last = last.select("seq", F.when(F.col("tombstone"), "DELETE").otherwise("UPDATE").alias("kind"), F.col("id").alias("record_id"), F.col("valid_from").alias("event_at"), F.lit(True).alias("last"))
    asked = channels.changes.select("seq", "kind", "record_id", "event_at", F.lit(False).alias("last")).union(last)
    both = written(channels.credited(asked, "last"), "credited")
    each = both.where("not last")
    counts = each.groupBy("arm").agg(
        F.count("*").alias("n_changes"), F.count("latency").alias("n_detected"), (F.count("*") - F.count("latency")).alias("n_missed"),
        F.count_if(F.col("source") == "webhook").alias("by_webhook"), F.count_if(F.col("source") == "poll").alias("by_poll"), F.max("latency").alias("max_latency"))
    wrong = both.where("last").groupBy("arm").agg(F.count_if(F.col("latency").isNull()).alias("wrong"))
    middle = percentiles(each.where("latency is not null"), ["arm"], "latency", [50, 95]).drop("n")
    return counts.join(middle, "arm", "left").join(wrong, "arm", "left").join(channels.calls(), "arm", "left")


def detection_by_read(spark, sf):
    return _credited(spark, sf).where("arm = 'both'").drop("arm")


def deletion_accounting(spark, sf):
    dead = _credited(spark, sf).where("kind in ('DELETE', 'MERGE')")
    return dead.groupBy("arm", "kind").agg(F.count("*").alias("happened"), F.count("latency").alias("detected"), (F.count("*") - F.count("latency")).alias("undetected"))


def frozen_watermarks(spark, sf):
    """What passes read if one in ten, and the first, fails after reading: its watermark stays."""
    versions = _versions(spark, sf, _changes(spark, sf))
    live = versions.where("not tombstone")
    spine = spark.range(1, PASSES + 1).select(F.col("id").alias("pass_no"))
    failed = spine.where((F.col("pass_no") == 1) | (draw("fail", "pass_no") % 10 == 0))
    marks = sync.watermarks(versions, INTERVAL, PASSES).withColumn("pass_no", F.col("pass_no").cast("long"))
    bounds = written(sync.guarded_watermarks(marks, failed), "bounds")
    full = bounds.where("lower is null").count()  # passes before the first success
    read = scan.at_passes(live.where(F.col("last_modified") >= -OVERLAP), INTERVAL, PASSES).join(F.broadcast(bounds), "pass_no").where(F.col("last_modified") >= F.col("lower") - OVERLAP)
    every = scan.at_passes(live, INTERVAL, full).withColumn("lower", F.lit(None).cast("double"))
    rows = read.select("pass_no", "lower").union(every.select("pass_no", "lower"))
    return rows.groupBy(F.col("pass_no").cast("long").alias("pass_no"), "lower").agg(F.count("*").alias("n_read"))


def _log(spark, sf):
    """Events as versioned writes and delete marks in order of arrival, some of them twice."""
    late = F.col("event_id") + draw("late", "event_id") % 50
    rows = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("version"), (late * 1_000_000_000 + F.col("event_id")).alias("arrival_no"), (F.col("event_type") == "error").alias("mark"))
    again = rows.where(draw("again", "version") % 20 == 0).withColumn("arrival_no", F.col("arrival_no") + 500_000_000)
    return rows.union(again)


def store_stats(spark, sf):
    return upsert.counters(_log(spark, sf), "user_id", "version", "arrival_no", "mark")


def unversioned_state(spark, sf):
    return upsert.unversioned(_log(spark, sf).where("not mark"), "user_id", "version", "arrival_no")


def _pass_sizes(spark, sf, changes):
    read = sync.reads(_versions(spark, sf, changes), _one(spark), INTERVAL, PASSES)
    return read.groupBy(F.col("pass_no").cast("long").alias("pass_no")).agg(F.count("*").alias("n_rows"))


def endpoint_usage(spark, sf):
    """Calls by endpoint over the horizon, and each one's share: a pass stops at its first short
    page, a backfill at its first empty one."""
    changes = _changes(spark, sf)
    sizes = _pass_sizes(spark, sf, changes).agg((F.sum(F.floor(F.col("n_rows") / PAGE) + 1) + PASSES - F.count("*")).alias("calls"))
    backfill = fixtures.records(spark, sf).agg((F.ceil(F.count("*") / PAGE) + 1).alias("calls"))
    hints = channel.first_seen(channel.deliveries(changes)).agg(F.count("*").alias("calls"))
    deletes = spark.range(1).select(F.lit(PASSES).alias("calls"))
    out = None
    for name, rows in (("backfill", backfill), ("query_modified_since", sizes), ("get_deleted", deletes), ("get_many", hints)):
        one = rows.select(F.lit(name).alias("endpoint"), F.col("calls").cast("long").alias("calls"))
        out = one if out is None else out.union(one)
    return out.withColumn("share", F.bround(F.col("calls") / F.sum("calls").over(Window.partitionBy()), 6))  # four rows


def short_page_loss(spark, sf):
    """Rows of a pass that are lost where the vendor's cap is under the page size asked for, so that
    every full page looks short and the pass stops after one."""
    caps = spark.createDataFrame([(100,), (200,)], "cap long")
    each = _pass_sizes(spark, sf, _changes(spark, sf)).crossJoin(F.broadcast(caps))
    lost = F.when(F.col("cap") < PAGE, F.greatest(F.col("n_rows") - F.col("cap"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return each.select("cap", "pass_no", "n_rows", lost.alias("n_lost"))


def world_field_changes(spark, sf):
    return fixtures.field_changes(fixtures.mutations(spark, sf))


def world_redirects(spark, sf):
    return fixtures.redirects(spark, sf)


def full_field_compare(spark, sf):
    """By field: values that live upstream records had set, and those that the local copy, at its
    version of the record, holds otherwise."""
    changes = _changes(spark, sf)
    versions = _versions(spark, sf, changes)
    local = _copy(spark, sf, versions).select(F.col("id").alias("record_id"), F.col("version").alias("held"))
    at = versions.select(F.col("id").alias("record_id"), "seq", "version")
    rows = fixtures.field_changes(changes).join(at, ["record_id", "seq"]).join(local, "record_id")
    rows = rows.join(sync.truth_at(versions, HORIZON).select(F.col("id").alias("record_id")), "record_id", "left_semi")
    each = rows.groupBy("record_id", "field").agg(
        F.max_by("value", "seq").alias("t"), F.max_by("value", F.when(F.col("version") <= F.col("held"), F.col("seq"))).alias("l"))
    return each.groupBy("field").agg(F.count("*").alias("n_values"), F.count_if(~F.col("t").eqNullSafe(F.col("l"))).alias("n_wrong"))


def _copy(spark, sf, versions):
    arms = _one(spark)
    local = sync.local_copy(fixtures.records(spark, sf), sync.reads(versions, arms, INTERVAL, PASSES), arms).select("id", "version")
    dead = scan.as_of(versions, HORIZON).where("tombstone and id % 7 <> 0").select("id")
    return local.join(dead, "id", "left_anti").where("id % 911 <> 5")


def _scores(spark, sf, arms):
    versions = _versions(spark, sf, _changes(spark, sf))
    local = sync.local_copy(fixtures.records(spark, sf), sync.reads(versions, arms, INTERVAL, PASSES), arms)
    return sync.score(sync.compare(sync.truth_at(versions, HORIZON), local, arms))


def accuracy_both_denominators(spark, sf):
    return _scores(spark, sf, _one(spark)).select("arm", "accuracy", "held_accuracy")


def result_json(spark, sf):
    """The sweep's scores as JSON documents, keys in order."""
    arms = _arms(spark, [(f"overlap_{o:04d}", float(o), True, False) for o in (0, 30, 60, 120, 300, 600, 1800)])
    return _scores(spark, sf, arms).select(F.to_json(F.struct("accuracy", "arm", "correct", "ghost", "stale")).alias("document"))


def bar_chart_calls(spark, sf):
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    paged = (F.ceil(F.col("n") / PAGE) + 1).cast("long")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), c.alias("n")) for k, c in (("bulk export", F.lit(1).cast("long")), ("one fetch a row", paged + F.col("n")), ("paged scan", paged)))))
    return report.bars(n.select(rows.alias("r")).select("r.*"), "label", "n")


def bar_chart_detection(spark, sf):
    versions = _versions(spark, sf, _changes(spark, sf))
    rows = reconcile.matrix(sync.truth_at(versions, HORIZON), _copy(spark, sf, versions))
    return report.bars(rows.select(F.col("strategy").alias("label"), F.col("detected").alias("n")), "label", "n")


def _stream(spark, rows, label):
    """rows, written, as a stream of files."""
    path = new_path(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark, stream):
    sink = new_path(spark, "sink")
    dedup.drain(stream, new_path(spark, "state"), sink)
    return spark.read.schema(stream.schema).parquet(sink)


def stream_dedup_equals_batch(spark, sf):
    sent = channel.deliveries(fixtures.mutations(spark, sf)).select("event_id", "seq", F.timestamp_micros((F.col("arrival") * 1_000_000).cast("long")).alias("at"))
    return _drained(spark, dedup.dedup(_stream(spark, sent, "sent"), "event_id", "at", "1 hour")).select("event_id", "seq")


def stream_windowed_counts(spark, sf):
    """Events by day, of the days that the watermark has closed."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"))
    counts = dedup.windowed_counts(_stream(spark, events, "events"), "at", "1 day", "0 seconds", [])
    return _drained(spark, counts.select(F.unix_seconds("window.start").alias("window_start"), "n"))


def detection_latency(spark, sf):
    return detection_by_read(spark, sf)


def latency_percentiles(spark, sf):
    return percentiles(detection_by_read(spark, sf).where("latency is not null"), ["source"], "latency", [50, 95, 100])


def webhook_poll_delta(spark, sf):
    return detection_by_read(spark, sf).groupBy("kind").agg(
        F.count_if(F.col("source") == "webhook").alias("by_webhook"), F.count_if(F.col("source") == "poll").alias("by_poll"),
        F.count_if(F.col("source").isNull()).alias("undetected"))


def score_by_kind(spark, sf):
    """Changes by kind if deletions aren't asked for."""
    return score_by_kind_arms(spark, sf).where("arm = 'plain'").drop("arm")


_NAMES = """
detection_latency latency_percentiles webhook_poll_delta score_by_kind deletion_ladder prediction_tally bar_chart_ghosts score_by_kind_arms channel_arms detection_by_read deletion_accounting
frozen_watermarks store_stats unversioned_state endpoint_usage short_page_loss world_field_changes world_redirects
full_field_compare accuracy_both_denominators result_json bar_chart_calls bar_chart_detection
stream_dedup_equals_batch stream_windowed_counts
""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
