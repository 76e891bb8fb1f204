"""Registered queries over stores, sources and streams: scans by a vendor's API, resumed backfills,
digest trees, merge chains, states at any instant, keyed state and joins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog_arms as arms
from tidemark.functions.draws import bucket, draw
from tidemark.operators import asof, backfill, chains, channel, digest, report, scan, sync
from tidemark.plans.stage import new_path, written
from tidemark.sources import fixtures, results, vendor
from tidemark.sources.fixtures import HORIZON, INTERVAL
from tidemark.sources.rules import with_rules
from tidemark.streaming import dedup, joins, state, store
from tidemark.streaming.feed import fed

#: Rows of a backfill's range, ten pages at least; ranges at most.
RANGE, RANGES = 2000, 1000
HALF, QUARTER = 14_400.0, 7200.0


def _store(spark: SparkSession, label: str) -> str:
    vendor.register(spark)
    return new_path(spark, label)


def vendor_modified_since(spark, sf):
    """What scans of two vendors' APIs give since half of the time; one of them keeps archived rows."""
    changes, out = arms._changes(spark, sf), None
    for name in ("atlas", "beacon"):
        state = scan.as_of(arms._versions(spark, sf, changes, name == "beacon"), HORIZON).select("id", "version", "last_modified", "tombstone")
        path = _store(spark, name)
        vendor.publish(written(state if name == "beacon" else state.where("not tombstone"), "state"), path)
        found = spark.read.format(vendor.NAME).load(path).where(F.col("last_modified") >= HALF)
        one = found.select(F.lit(name).alias("vendor"), "id", "version", "last_modified", "tombstone")
        out = one if out is None else out.union(one)
    return out


def vendor_stream_reads(spark, sf):
    """What a stream of modified rows gives, published in four parts; a part's stamps under the
    highest one of an earlier part are lost. The stream stops and starts again between parts."""
    rows = arms._versions(spark, sf, arms._changes(spark, sf)).where("valid_from >= 0 and not tombstone").select("id", "seq", "version", "last_modified", "valid_from")
    path, held, sink = _store(spark, "stream"), new_path(spark, "state"), new_path(spark, "sink")
    stream = spark.readStream.schema(rows.schema).format(vendor.NAME).load(path)
    for k in range(4):
        vendor.publish(rows.where(F.least(F.lit(3), F.floor(F.col("valid_from") / QUARTER)) == k), path)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", held).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink).drop("valid_from")


def _per_range(rows: DataFrame) -> int:
    return max(RANGE, rows.count() // RANGES)


def backfill_resumed(spark, sf):
    """A backfill whose first attempt commits two ranges and loses a third, whose second takes one
    more, and whose third finishes: by range its rows, how often it was read, the attempt that
    committed it and the watermark after that."""
    rows = fixtures.records(spark, sf).select("id", "last_modified")
    folder, size, marks, read = new_path(spark, "backfill"), _per_range(rows), [], None
    for k, (budget, fails) in enumerate(((2, 1), (1, None), (None, None)), 1):
        left = backfill.plan(rows, folder, "last_modified", "id", size).join(backfill.committed(spark, folder), "range", "left_anti").orderBy("range")
        tried = written((left if budget is None else left.limit(budget + (fails or 0))).select("range", F.lit(k).alias("attempt")), "tried")
        backfill.attempt(rows, folder, "last_modified", "id", size, budget, fails)
        read = tried if read is None else read.union(tried)
        marks.append(backfill.watermark(spark, folder, 0.0))
    done = read.groupBy("range").agg(F.count("*").alias("n_reads"), F.max("attempt").cast("long").alias("attempt"))
    mark = F.element_at(F.array(*(F.lit(m).cast("double") for m in marks)), F.col("attempt").cast("int"))
    return backfill.committed(spark, folder).join(done, "range").select("range", "n", "n_reads", "attempt", mark.alias("watermark"))


def backfill_copy(spark, sf):
    """The copy that an interrupted backfill leaves once it was resumed."""
    rows = fixtures.records(spark, sf)
    folder, size = new_path(spark, "backfill"), _per_range(rows)
    for budget, fails in ((1, 1), (2, 2), (None, None)):
        backfill.attempt(rows, folder, "last_modified", "id", size, budget, fails)
    return backfill.copied(spark, folder, rows.schema)


def manifest_digest(spark, sf):
    """The root of the ordered digest of all records, and of all changes."""
    recs, changes = fixtures.records(spark, sf), arms._changes(spark, sf)
    one = digest.tree(recs.withColumn("stamp", F.col("last_modified").cast("long")), "id", ["owner", "stage", "stamp"])
    two = digest.tree(changes, "seq", ["kind", "record_id", "merged_into"])
    root = lambda df, name: df.where(F.col("level") == digest.LEVELS).select(F.lit(name).alias("part"), "n", "digest")
    return root(one, "records").union(root(two, "changes"))


def tree_reconcile(spark, sf):
    """Nodes by level that reconciliations of digest trees ask for and find to differ, of those there
    are: of a copy that passes left, and of one that lacks a record in a thousand."""
    versions = arms._versions(spark, sf, arms._changes(spark, sf))
    truth, out = sync.truth_at(versions, HORIZON), None
    left = written(digest.tree(truth, "id", ["version"]), "tree")
    for name, copy in (("passes", arms._copy(spark, sf, versions)), ("rare", truth.where("id % 911 <> 5"))):
        asked = digest.descent(left, written(digest.tree(copy, "id", ["version"]), "tree"))
        asked = asked.groupBy("level").agg(F.count("*").alias("n_asked"), F.count_if("differs").alias("n_differing"))
        one = left.groupBy("level").agg(F.count("*").alias("n_nodes")).join(asked, "level", "left").na.fill(0).select(F.lit(name).alias("copy"), "*")
        out = one if out is None else out.union(one)
    return out


def merge_survivors(spark, sf):
    """The last record that a chain of merges leads to; a merge counts if its other record is alive."""
    changes = arms._changes(spark, sf)
    deaths = changes.where("seq = death").select(F.col("record_id").alias("merged_into"), F.col("death").alias("died"))
    merges = changes.where("kind = 'MERGE'").join(deaths, "merged_into", "left").where("died is null or seq < died").select("record_id", "merged_into")
    last = chains.ends(merges, "record_id", "merged_into")
    dead = deaths.select("merged_into", F.lit(True).alias("dead"))
    return last.join(dead, "merged_into", "left").select("record_id", F.col("merged_into").alias("survivor"), "hops", F.coalesce("dead", F.lit(False)).alias("dead"))


def deliveries_as_of(spark, sf):
    """What a record is when a delivery about it arrives."""
    changes = arms._changes(spark, sf)
    sent = channel.deliveries(changes).select("event_id", "copy", "arrival", F.col("record_id").alias("id"))
    versions = arms._versions(spark, sf, changes).drop("seq", "last_modified")
    return asof.join(sent, versions, "id", "arrival", "valid_from", "valid_to", leaf=1.0, levels=6).drop("valid_from", "valid_to")


SUBSCRIPTIONS, PARTS, BUCKETS = 4, 3, 64
#: Seconds: how long a hint is waited for, how late rows may be, how long an arrival is remembered.
WITHIN, LATE, KEPT = 60, 20, 120


def _moment(seconds):
    return F.timestamp_micros(F.lit(fixtures.EPOCH_US) + F.round(seconds * 1_000_000).cast("long"))


def _parts(rows, at: str, extra=None):
    """rows in PARTS parts by time, and a last part with extra rows, which ends all that waits."""
    part = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor(F.col(at) / (HORIZON / PARTS))))
    out = [rows.where(part == k) for k in range(PARTS)]
    return out if extra is None else [*out, extra]


def stream_failure_runs(spark, sf):
    """Failures in a row by subscription, four of them, each disabled after 25; the query stops and
    starts again between three parts of the log."""
    tried = F.col("event_at") + channel.lag()
    changes = fixtures.mutations(spark, sf).select((F.col("record_id") % SUBSCRIPTIONS).alias("subscription"), "seq", "event_at", tried.between(*arms.OUTAGE).alias("down"))
    with state.rocksdb(spark):
        return fed(spark, lambda s: state.failure_runs(s, arms.DISABLE_AFTER), _parts(written(changes, "changes"), "event_at"))[0]


def stream_first_arrivals(spark, sf):
    """First deliveries of events, each remembered for two minutes after it."""
    sent = channel.deliveries(fixtures.mutations(spark, sf)).select("event_id", "seq", "arrival", _moment(F.col("arrival")).alias("at"))
    sent = written(sent, "sent")
    with state.rocksdb(spark):
        return fed(spark, lambda s: state.first_arrivals(s, "event_id", "at", f"{LATE} seconds", KEPT * 1000), _parts(sent, "arrival"))[0].select("event_id", "seq", "arrival")


def _hints(spark, sf):
    """Changes and the first deliveries about them, in parts; a last part far ahead closes the wait."""
    changes = arms._changes(spark, sf)
    sent = written(channel.first_seen(channel.deliveries(changes)).select("record_id", "arrival", _moment(F.col("arrival")).alias("hinted")), "hints")
    rows = changes.select("seq", "record_id", "event_at", _moment(F.col("event_at")).alias("changed"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("record_id"), F.lit(2 * HORIZON).alias("t"))
    last = end.select(F.lit(-1).cast("long").alias("seq"), "record_id", F.col("t").alias("event_at"), _moment(F.col("t")).alias("changed"))
    return _parts(rows, "event_at", last), _parts(sent, "arrival", end.select("record_id", F.col("t").alias("arrival"), _moment(F.col("t")).alias("hinted")))


def stream_hinted_changes(spark, sf):
    """For each change the first hint about its record within a minute: two streams joined."""
    rows, _ = fed(spark, lambda c, h: joins.hinted(c.drop("event_at"), h, f"{WITHIN} seconds", f"{LATE} seconds"), *_hints(spark, sf))
    return rows.where("seq >= 0").groupBy("seq").agg((F.unix_micros(F.min("hinted")) - fixtures.EPOCH_US).alias("hinted_us"))


def stream_hint_rereads(spark, sf):
    """What the re-read that a hint asks for finds: a stream joined with the table of versions."""
    changes = arms._changes(spark, sf)
    versions = arms._versions(spark, sf, changes)
    sent = written(channel.first_seen(channel.deliveries(changes)).select("event_id", "record_id", "arrival"), "hints")
    return fed(spark, lambda s: joins.reread(s, versions), _parts(sent, "arrival"))[0]


def stream_late_rows(spark, sf):
    """Deliveries that come after their time was closed, as one in fifty is held up until the next
    part: as the stream's progress counts them and as an anti join with the log finds them."""
    held = F.when(draw("held", "seq") % 50 == 0, HORIZON / PARTS).otherwise(0.0)
    sent = channel.first_seen(channel.deliveries(fixtures.mutations(spark, sf)))
    sent = written(sent.select("event_id", (F.col("arrival") + held).alias("arrival"), _moment(F.col("event_at")).alias("at")), "sent")
    rows, progress = fed(spark, lambda s: dedup.dedup(s, "event_id", "at", f"{LATE} seconds"), _parts(sent, "arrival"))
    dropped = sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
    lost = sent.join(rows.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("n_missing"))
    return lost.crossJoin(sent.agg(F.count("*").alias("n_sent"))).select("n_sent", "n_missing", F.lit(dropped).cast("long").alias("n_dropped"))


def _writes(spark, sf):
    return fixtures.table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), "value")


def stream_upsert_equals_batch(spark, sf):
    """Events upserted by three batches of a stream, each into the buckets that it touches."""
    path, state_, feed = new_path(spark, "store"), new_path(spark, "state"), new_path(spark, "feed")
    writes = _writes(spark, sf)
    for k in range(PARTS):
        writes.where(F.col("version") % PARTS == k).write.mode("append").parquet(feed)
        store.upsert(spark.readStream.schema(writes.schema).parquet(feed), path, "user_id", "version", state_, BUCKETS)
    return store.read(spark, path)


def store_versions(spark, sf):
    """What merges of ever fewer buckets write, and the rows that the table then has."""
    path, out = new_path(spark, "store"), None
    writes = _writes(spark, sf)
    for k, most in enumerate((BUCKETS, 16, 4)):
        was = store.manifest(spark, path).folders
        now = store.merge(writes.where((F.col("version") % PARTS == k) & (bucket("store", "user_id", BUCKETS) < most)), path, "user_id", "version", BUCKETS)
        new = [f for b, f in now.folders.items() if was.get(b) != f]
        n_written = spark.read.schema(writes.schema).parquet(*new).agg(F.count("*").alias("n_written"))
        one = n_written.crossJoin(store.read(spark, path).agg(F.count("*").alias("n_rows")))
        one = one.select(F.lit(now.version).cast("long").alias("version"), F.lit(len(new)).cast("long").alias("n_buckets"), "n_written", "n_rows")
        out = one if out is None else out.union(one)
    return out


def result_json_read(spark, sf):
    """The sweep's scores written as documents with nested lists, read back and shredded."""
    rows = [(f"overlap_{o:04d}", float(o), True, False) for o in (0, 30, 60, 120, 300, 600, 1800)]
    scores = arms._scores(spark, sf, arms._arms(spark, rows))
    states = F.array(*(F.struct(F.col(c).alias("n"), F.lit(c).alias("state")) for c in ("correct", "stale", "missing", "ghost")))
    documents = scores.select("arm", "accuracy", states.alias("states"))
    path = new_path(spark, "results")
    results.write(documents, "arm", path)
    whole, _ = results.read(spark, path, documents.schema)
    return whole.select("arm", "accuracy", F.explode("states").alias("s")).select("arm", "accuracy", "s.state", "s.n")


def kind_sentences(spark, sf):
    """Changes by kind and hour as a report words them."""
    hour = F.floor(F.col("event_at") / 3600).cast("long")
    return fixtures.mutations(spark, sf).groupBy("kind", hour.alias("hour")).agg(F.count("*").alias("n")).select("kind", "hour", report.counted(F.col("n"), "change").alias("said"))


def vendor_costs(spark, sf):
    """Calls that each vendor's rules ask of a backfill, a re-read of all changed records, and a bulk
    export, and the rows that its search can't reach."""
    state = scan.as_of(arms._versions(spark, sf, arms._changes(spark, sf)), HORIZON)
    each = with_rules(state.select("tombstone", (F.col("valid_from") >= 0).alias("changed")))
    seen = ~F.col("tombstone") | F.col("retention").isNull()
    sums = each.groupBy("vendor", "page", "batch", "ceiling", "bulk").agg(F.count_if(seen).alias("n"), F.count_if(~F.col("tombstone") & F.col("changed")).alias("m"))
    calls = lambda n, size: F.ceil(n / size).cast("long")
    return sums.select(
        "vendor", F.col("n").alias("scannable"), (calls(F.col("n"), F.col("page")) + 1).alias("backfill"), calls(F.col("m"), F.col("batch")).alias("reread"),
        calls(F.col("n"), F.col("bulk")).alias("bulk_jobs"), F.greatest(F.lit(0), F.col("n") - F.col("ceiling")).alias("beyond_search"))


def score_over_time(spark, sf):
    """The copy against the truth up to each of four times, by the passes until then."""
    times = spark.createDataFrame([(f"{t:05d}", float(t)) for t in (7200, 14400, 21600, 28800)], "arm string, up_to double")
    versions = arms._versions(spark, sf, arms._changes(spark, sf))
    read = sync.reads(versions, arms._one(spark), INTERVAL, arms.PASSES).drop("arm")
    until = read.crossJoin(F.broadcast(times)).where(F.col("pass_no") * F.lit(INTERVAL) <= F.col("up_to"))
    local = sync.local_copy(fixtures.records(spark, sf), until, times)
    truth = scan.as_of(versions.crossJoin(F.broadcast(times)), F.col("up_to")).where("not tombstone").select("arm", "id", F.col("version").alias("true_version"))
    state = sync.states(truth.join(local, ["arm", "id"], "full_outer"))
    return sync.score(state).select(F.col("arm").cast("long").alias("up_to"), "correct", "stale", "ghost", "accuracy")


_NAMES = """
score_over_time vendor_costs stream_upsert_equals_batch store_versions result_json_read kind_sentences
stream_failure_runs stream_first_arrivals stream_hinted_changes stream_hint_rereads stream_late_rows
vendor_modified_since vendor_stream_reads backfill_resumed backfill_copy manifest_digest tree_reconcile merge_survivors
deliveries_as_of
""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
