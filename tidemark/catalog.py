"""Registered queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import catalog_arms, catalog_live, catalog_live_sql, catalog_sql
from tidemark.functions.draws import bucket, draw
from tidemark.operators import channel, limits, reconcile, report, scan, sync, upsert
from tidemark.plans.stage import written
from tidemark.sources import fixtures
from tidemark.sources.fixtures import HORIZON, INTERVAL, table

PASSES = 96
#: Fixed value: how many rows a search reaches, silently.
CEILING = 10_000
#: Fixed value: most rows of a bulk export.
BULK_CAP = 100_000
SINCE = "2000-01-01"
CURSOR = ("2000-03-01", 7500)
OUTAGE = (7200.0, 10800.0)
OVERLAPS = (0, 30, 60, 120, 300, 600, 1800)


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


def _changes(spark, sf):
    return fixtures.mutations(spark, sf)


def _versions(spark, sf):
    return fixtures.versions(fixtures.records(spark, sf), _changes(spark, sf))


def _truth(spark, sf):
    return sync.truth_at(_versions(spark, sf), HORIZON)


def _arms(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "arm string, overlap double, inclusive boolean")


LADDER = [("0 naive", 0.0, False), ("1 inclusive", 0.0, True), ("2 overlap_60", 60.0, True), ("3 overlap_300", 300.0, True)]
SWEEP = [(f"overlap_{o:04d}", float(o), True) for o in OVERLAPS]


def _compared(spark, sf, rows):
    recs, versions, arms = fixtures.records(spark, sf), _stored(_versions(spark, sf)), _arms(spark, rows)
    local = sync.local_copy(recs, sync.reads(versions, arms, INTERVAL, PASSES), arms)
    return sync.compare(sync.truth_at(versions, HORIZON), local, arms)


def _stored(df):
    """df, written once for queries that use it more often."""
    return written(df, "versions")


def _sides(spark, sf):
    """Truth and the local copy, from versions that are written once."""
    versions = _stored(_versions(spark, sf))
    return sync.truth_at(versions, HORIZON), _local(spark, sf, versions)


def _local(spark, sf, versions=None):
    """The copy that a 120 s overlap leaves, deletions marked for all but every seventh record."""
    versions = _stored(_versions(spark, sf)) if versions is None else versions
    recs, arms = fixtures.records(spark, sf), _arms(spark, [("a", 120.0, True)])
    local = sync.local_copy(recs, sync.reads(versions, arms, INTERVAL, PASSES), arms).select("id", "version")
    dead = scan.as_of(versions, HORIZON).where("tombstone and id % 7 <> 0").select("id")
    return local.join(dead, "id", "left_anti").where("id % 911 <> 5")


def modified_since_scan(spark, sf):
    return scan.modified_since(_orders(spark, sf), "o_orderdate", "o_orderkey", SINCE, limit=200)


def modified_since_cursor_page(spark, sf):
    return scan.modified_since(_orders(spark, sf), "o_orderdate", "o_orderkey", SINCE, limit=200, after=CURSOR)


def page_assignment(spark, sf):
    return scan.pages(_orders(spark, sf), "o_orderdate", "o_orderkey", 200)


def tie_group_boundaries(spark, sf):
    paged = scan.pages(_orders(spark, sf).select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 200)
    ties = paged.groupBy("o_orderdate").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("n_rows"))
    return ties.where("first_page < last_page")


def strict_vs_inclusive(spark, sf):
    df, bound = _orders(spark, sf), F.lit("2000-03-01").cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return df.agg(F.count_if(at >= bound).alias("inclusive"), F.count_if(at > bound).alias("strict"), F.count_if(at == bound).alias("lost"))


def search_ceiling(spark, sf):
    n = F.count("*")
    return _orders(spark, sf).agg(F.least(n, F.lit(CEILING)).alias("reachable"), F.greatest(n - CEILING, F.lit(0)).alias("beyond"))


def search_offset_page(spark, sf):
    """Rows 1,201 to 1,300, which lie below the ceiling: a page by offset and limit."""
    found = _orders(spark, sf).select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(1200).limit(100)
    rank = F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey"))  # over the page's rows
    return found.withColumn("rn", (1200 + rank).cast("long"))


def world_records(spark, sf):
    return fixtures.records(spark, sf)


def world_mutations(spark, sf):
    return _changes(spark, sf).drop("death")


def mutation_kind_counts(spark, sf):
    return _changes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


def future_stamp_violations(spark, sf):
    return _changes(spark, sf).groupBy("kind").agg(F.count_if(F.col("stamp") > F.col("event_at")).alias("n_future"))


def scd2_versions(spark, sf):
    return _versions(spark, sf)


def snapshot_as_of(spark, sf):
    times = F.explode(F.array(*(F.lit(float(t)) for t in (0, 7200, 14400, 28800))))
    v = _versions(spark, sf).withColumn("t", times)
    return scan.as_of(v, F.col("t")).groupBy("t").agg(
        F.count_if(~F.col("tombstone")).alias("n_live"), F.count_if("tombstone").alias("n_dead"),
        F.sum("version").cast("long").alias("sum_version"), F.max("last_modified").alias("max_stamp"))


def live_count(spark, sf):
    return _truth(spark, sf).agg(F.count("*").alias("n_live"))


def scannable_vs_live(spark, sf):
    state = scan.as_of(_versions(spark, sf), HORIZON)
    return state.agg(F.count("*").alias("n_scannable"), F.count_if(~F.col("tombstone")).alias("n_live"))


def id_inventory_page(spark, sf):
    return _truth(spark, sf).select("id").orderBy("id").offset(2000).limit(1000)


def get_by_ids(spark, sf):
    wanted = spark.range(0, 400, 2)
    return _truth(spark, sf).join(wanted, "id", "left_semi")


def bulk_export(spark, sf):
    rows = scan.as_of(_versions(spark, sf), 900.05).where("not tombstone").select("id", "version").orderBy("id").limit(BULK_CAP)
    return rows.agg(F.count("*").alias("n_rows"), F.sum("version").cast("long").alias("sum_version"))


def deletes_window(spark, sf):
    dead = _changes(spark, sf).where("kind in ('DELETE', 'MERGE')")
    pass_no = F.greatest(F.lit(1), F.ceil(F.col("event_at") / INTERVAL)).cast("long")
    return dead.groupBy(pass_no.alias("pass_no")).agg(F.count("*").alias("n_deletes")).where(f"pass_no <= {PASSES}")


def deletes_forgotten(spark, sf):
    dead = _changes(spark, sf).where("kind in ('DELETE', 'MERGE')")
    return dead.agg(F.count_if(F.col("event_at") < HORIZON - 7200).alias("n_forgotten"), F.count_if(F.col("event_at") >= HORIZON - 7200).alias("n_visible"))


def manifest_checksum(spark, sf):
    """Four sums of per-row digests: order-free, so no task holds the whole table; together 128 bits
    and more that every field of every row enters."""
    row = F.concat_ws("|", "id", "owner", "stage", F.col("last_modified").cast("long").cast("string"))
    sums = [F.sum(draw(f"row{i}", row)).cast("long").alias(f"sum{i}") for i in range(4)]
    return fixtures.records(spark, sf).agg(*sums, F.count("*").alias("n"))


def pass_watermarks(spark, sf):
    return sync.watermarks(_versions(spark, sf), INTERVAL, PASSES).withColumn("pass_no", F.col("pass_no").cast("long"))


def overlap_reads(spark, sf):
    read = sync.reads(_versions(spark, sf), _arms(spark, SWEEP), INTERVAL, PASSES)
    return read.groupBy("arm", F.col("pass_no").cast("long").alias("pass_no")).agg(F.count("*").alias("n_read"))


def timestamp_only_page_loss(spark, sf):
    read = sync.reads(_versions(spark, sf), _arms(spark, [("a", 1800.0, True)]), INTERVAL, PASSES)
    return read.groupBy(F.col("pass_no").cast("long").alias("pass_no")).agg(F.greatest(F.count("*") - 200, F.lit(0)).alias("n_lost"), F.count("*").alias("n_rows"))


def redundant_reads(spark, sf):
    return sync.redundant(sync.reads(_versions(spark, sf), _arms(spark, SWEEP), INTERVAL, PASSES))


def mitigation_ladder(spark, sf):
    plain = sync.score(_compared(spark, sf, LADDER))
    w = Window.partitionBy().orderBy("arm")  # one row per rung
    return plain.withColumn("gain", F.coalesce(F.lag("wrong").over(w) - F.col("wrong"), F.lit(0).cast("long")))


def overlap_sweep(spark, sf):
    return sync.score(_compared(spark, sf, SWEEP)).select("arm", "stale", "ghost", "wrong", "accuracy")


def overlap_knee(spark, sf):
    swept = sync.score(_compared(spark, sf, SWEEP)).select("arm", "wrong")
    best = swept.agg(F.min("wrong").alias("best"))
    return swept.crossJoin(best).where("wrong <= best + 1").agg(F.min("arm").alias("knee"), F.min("best").alias("best"))


def attribute_wrong(spark, sf):
    """The kind of the last change of each wrong record."""
    wrong = _compared(spark, sf, [("a", 120.0, True)]).where("state <> 'correct'").select(F.col("id").alias("record_id"))
    last = _changes(spark, sf).join(wrong, "record_id", "left_semi").groupBy("record_id").agg(F.max_by("kind", "seq").alias("cause"))
    return wrong.join(last, "record_id", "left").groupBy(F.coalesce("cause", F.lit("unattributed")).alias("cause")).agg(F.count("*").alias("n"))


def drift_report(spark, sf):
    return reconcile.drift(*_sides(spark, sf))


def count_check(spark, sf):
    truth, local = _sides(spark, sf)
    n, m = truth.agg(F.count("*").alias("upstream_n")), local.agg(F.count("*").alias("local_n"))
    return n.crossJoin(m).withColumn("differs", F.col("upstream_n") != F.col("local_n"))


def partitioned_checksum(spark, sf):
    return reconcile.differing(*_sides(spark, sf), 400)


def full_id_inventory(spark, sf):
    return reconcile.membership(*_sides(spark, sf))


def recon_matrix(spark, sf):
    return reconcile.matrix(*_sides(spark, sf)).drop("detected_per_call")


def recon_cost(spark, sf):
    """What each strategy's calls buy."""
    return reconcile.matrix(*_sides(spark, sf)).select("strategy", "calls", "detected", "calls_per_1k", "detected_per_call")


def webhook_deliveries(spark, sf):
    return channel.deliveries(_changes(spark, sf))


def webhook_dedup(spark, sf):
    return channel.first_seen(channel.deliveries(_changes(spark, sf))).drop("copy")


def channel_stats(spark, sf):
    c = _changes(spark, sf)
    return c.agg(
        F.count("*").alias("emitted"), F.count_if(draw("wl", "seq") % 100 < 3).alias("lost"),
        F.count_if((draw("wl", "seq") % 100 >= 3) & (draw("w2", "seq") % 100 < 5)).alias("duplicated"),
        F.count_if((draw("wl", "seq") % 100 >= 3) & (draw("wr", "seq") % 100 < 4)).alias("reordered"))


def subscription_disable(spark, sf):
    runs = channel.failure_runs(_changes(spark, sf), *OUTAGE)
    off = runs.where("down and run = 25").agg(F.min("seq").alias("disabled_seq"), F.min_by("arrival", "seq").alias("disabled_at"))
    return off.crossJoin(runs.agg(F.max("run").alias("longest_run"), F.count_if("down").alias("n_failed")))


def upsert_latest(spark, sf):
    """Last write wins by version, an equal version overwrites: events as versioned writes in arrival order."""
    e = _arrivals(spark, sf)
    return e.groupBy("user_id").agg(F.max("version").alias("version"), F.max_by("value", F.struct("version", "arrival_no")).alias("value"))


def _arrivals(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("mark"))
    return e.select("user_id", "value", "mark", F.col("event_id").alias("version"), (F.col("event_id") + bucket("late", "event_id", 50)).alias("slot")).withColumn(
        "arrival_no", F.col("slot") * 1_000_000_000 + F.col("version"))


def out_of_order_rejects(spark, sf):
    w = Window.partitionBy("user_id").orderBy("arrival_no").rowsBetween(Window.unboundedPreceding, -1)
    e = _arrivals(spark, sf).withColumn("held", F.max("version").over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("version") < F.col("held")).alias("n_rejected"), F.count("*").alias("n_writes"))


def redundant_upserts(spark, sf):
    sent = channel.deliveries(_changes(spark, sf)).groupBy("record_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_distinct"))
    return sent.where("n > n_distinct").select("record_id", (F.col("n") - F.col("n_distinct")).alias("n_redundant"))


def resurrections(spark, sf):
    """Rows marked deleted (error events) that a later write brings back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("mark"))
    back = e.withColumn("was", F.lag("mark").over(w)).where("was and not mark")
    return back.groupBy("user_id").agg(F.count("*").alias("n_back"))


def access_pattern_cost(spark, sf):
    """Calls of a paged scan, a scan with a fetch per row, and a bulk export."""
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    sizes = spark.createDataFrame([(20,), (100,), (200,)], "page_size long")
    paged = (F.ceil(F.col("n") / F.col("page_size")) + 1).cast("long")
    return n.crossJoin(F.broadcast(sizes)).select("page_size", paged.alias("paged"), (paged + F.col("n")).alias("detail"), F.lit(1).cast("long").alias("bulk"))


def _calls(spark, sf):
    """Events as calls of their users, on the time scale of the changes."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - fixtures.EPOCH_US) / F.lit(1e6) / fixtures.SCALE
    return table(spark, sf, "events").select("user_id", (F.col("event_id") + 1).alias("seq"), at.alias("at"))


def _started(calls):
    return calls.select("user_id", "seq", "call_no", "start")


def fixed_sleep_schedule(spark, sf):
    return _started(limits.fixed_sleep(_calls(spark, sf), "user_id", "at", "seq", 300.0))


def token_bucket_schedule(spark, sf):
    return _started(limits.token_bucket(_calls(spark, sf), "user_id", "at", "seq", 1 / 300, 3))


def rate_window_admission(spark, sf):
    """Calls over three in 900 seconds."""
    out = limits.window_load(_calls(spark, sf), "user_id", "at", "seq", 900, 3)
    return out.select("user_id", "seq", "in_window", "over")


def score(spark, sf):
    return sync.score(_compared(spark, sf, [("a", 120.0, True)]))


def local_live(spark, sf):
    return _local(spark, sf)


def store_state(spark, sf):
    """What a versioned store holds after upserts and delete marks (error events) in arrival order."""
    return upsert.apply_log(_arrivals(spark, sf), "user_id", "version", "arrival_no", "mark")


def bar_chart_kinds(spark, sf):
    return report.bars(mutation_kind_counts(spark, sf).select("kind", "n"), "kind", "n")


def ext_loss_rollup(spark, sf):
    hour = F.floor(F.col("event_at") / 3600).cast("long")
    c = _changes(spark, sf).withColumn("hour", hour).rollup("kind", "hour").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return c


def ext_change_rate_window(spark, sf):
    return _changes(spark, sf).groupBy((F.floor(F.col("event_at") / 300) * 300).cast("long").alias("window_start")).agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


def ext_record_sessions(spark, sf):
    w = Window.partitionBy("record_id").orderBy("seq")
    c = _changes(spark, sf).withColumn("gap", F.col("event_at") - F.lag("event_at").over(w))
    s = c.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 600), 1).otherwise(0)).over(w))
    return s.groupBy("record_id", "session").agg(F.count("*").alias("n"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"))


_NAMES = """
modified_since_scan modified_since_cursor_page page_assignment tie_group_boundaries strict_vs_inclusive
search_ceiling search_offset_page world_records world_mutations mutation_kind_counts future_stamp_violations
scd2_versions snapshot_as_of live_count scannable_vs_live id_inventory_page get_by_ids bulk_export deletes_window
deletes_forgotten manifest_checksum pass_watermarks overlap_reads timestamp_only_page_loss redundant_reads
mitigation_ladder overlap_sweep overlap_knee attribute_wrong drift_report count_check
partitioned_checksum full_id_inventory recon_matrix recon_cost webhook_deliveries webhook_dedup channel_stats
subscription_disable upsert_latest out_of_order_rejects
redundant_upserts resurrections store_state score local_live rate_window_admission access_pattern_cost fixed_sleep_schedule token_bucket_schedule bar_chart_kinds
ext_loss_rollup ext_change_rate_window ext_record_sessions
""".split()
QUERIES = {name: globals()[name] for name in _NAMES} | catalog_arms.QUERIES | catalog_live.QUERIES
ORACLES = catalog_sql.ORACLES | catalog_live_sql.ORACLES
