"""Every registered query against its SQL, and properties that hold over their results."""

import math

import duckdb
import numpy as np
import pytest

from tidemark import catalog
from tidemark.functions import ranks
from tidemark.operators import channel, limits, scan, sync, upsert
from tidemark.streaming import dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "events", "customer", "lineitem"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == names
    want = duck.sql(f"select {', '.join(names)} from ({catalog.ORACLES[name]})").fetchall()
    rows = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_wrong_never_grows_with_the_overlap(spark):
    wrong = [r.wrong for r in catalog.overlap_sweep(spark, SF).orderBy("arm").collect()]
    assert wrong == sorted(wrong, reverse=True)


def test_only_comparing_fields_finds_all(spark):
    rate = {r.strategy: r.rate for r in catalog.recon_matrix(spark, SF).collect()}
    assert rate["full_field_compare"] == 1.0 and rate["count_check"] == rate["none"] == 0.0


def test_attribution_covers_all_wrong_records(spark):
    wrong = catalog._compared(spark, SF, [("a", 120.0, True)]).where("state <> 'correct'").count()
    assert sum(r.n for r in catalog.attribute_wrong(spark, SF).collect()) == wrong


def test_cursor_pages_cover_a_tie_group_once(spark):
    ties = spark.createDataFrame([(i, 5.0) for i in (3, 9, 1, 7, 5, 2, 8, 4, 6)], "id long, stamp double")
    seen, cursor = [], None
    while page := scan.modified_since(ties, "stamp", "id", 5.0, limit=2, after=cursor).collect():
        seen += [r.id for r in page]
        cursor = (page[-1].stamp, page[-1].id)
    assert seen == list(range(1, 10))


def test_scan_is_pushed_down(spark):
    text = catalog.modified_since_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(o_orderdate" in text


def test_dead_records_do_not_change(spark):
    changes = catalog._changes(spark, SF)
    assert changes.where("seq > death").isEmpty()


def test_snapshot_ties_versions_to_truth(spark):
    versions = catalog._versions(spark, SF)
    assert scan.as_of(versions, 28800.0).count() == catalog.world_records(spark, SF).count()
    assert sync.truth_at(versions, 0.0).count() <= sync.truth_at(versions, -0.5).count()


def test_streaming_dedup_equals_batch(spark, tmp_path):
    sent = catalog.webhook_deliveries(spark, SF).selectExpr("event_id", "seq", "timestamp_micros(cast(arrival * 1000000 as bigint)) as at")
    sent.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in"))
    dedup.drain(dedup.dedup(stream, "event_id", "at", "1 hour"), str(tmp_path / "state"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.event_id for r in got.collect()} == {r.event_id for r in catalog.webhook_dedup(spark, SF).collect()}
    assert got.count() == got.select("event_id").distinct().count()



def test_store_rejects_older_versions_and_keeps_marks(spark):
    log = [(1, 5, 1, False), (1, 2, 2, False), (2, 1, 1, False), (2, 0, 2, True), (3, 1, 1, False), (3, 0, 2, True), (3, 1, 3, False),
           (4, 0, 1, True), (5, 3, 1, False), (5, 0, 2, True), (5, 2, 3, False)]
    df = spark.createDataFrame(log, "k long, version long, no long, mark boolean")
    got = {r.k: (r.version, r.deleted) for r in upsert.apply_log(df, "k", "version", "no", "mark").collect()}
    assert got == {1: (5, False), 2: (1, True), 3: (1, False), 5: (3, True)}


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbers_hold_with_columns_outside_the_order(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = scan.numbered(catalog.table(spark, "/root/testdata/sf0.01", "orders"), ["o_orderdate", "o_orderkey"]).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = sorted(rows, key=lambda r: (r.o_orderdate, r.o_orderkey))
    assert [r.rn for r in want] == list(range(1, len(rows) + 1))


def test_waiting_rules_match_a_loop(spark):
    rng = np.random.default_rng(3)
    calls = [(int(u), i, float(t)) for i, (u, t) in enumerate(zip(rng.integers(0, 4, 300), np.sort(rng.uniform(0, 100, 300))))]
    df = spark.createDataFrame(calls, "who long, no long, at double")
    slept = {r.no: r.start for r in limits.fixed_sleep(df, "who", "at", "no", 2.0).collect()}
    taken = {r.no: r.start for r in limits.token_bucket(df, "who", "at", "no", 0.5, 3).collect()}
    load = {r.no: r.in_window for r in limits.window_load(df, "who", "at", "no", 5, 2).collect()}
    last, tokens, when = {}, {}, {}
    for u, i, t in calls:
        start = max(t, last.get(u, -1e9) + 2.0)
        last[u] = start
        assert slept[i] == pytest.approx(start)
        before, have = when.get(u, (0.0, 3.0))
        now = max(t, before)
        have = min(3.0, have + (now - before) * 0.5)
        if have < 1:
            now, have = now + (1 - have) / 0.5, 1.0
        when[u] = (now, have - 1)
        assert taken[i] == pytest.approx(now)
        assert load[i] == sum(v == u and t - 5 < s <= t for v, _, s in calls)


def test_percentiles_with_ties_match_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 20, 2000)] + [("b", float(x)) for x in rng.normal(size=3001)] + [("c", 1.0)]
    got = {r.g: r for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [1, 50, 95, 100]).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        for p in (1, 50, 95, 100):
            assert got[g][f"p{p}"] == v[max(0, min(len(v) - 1, round(p / 100 * len(v) + 0.5) - 1))]


def test_failure_runs_cross_ranges(spark):
    rows = [(i, float(i), "UPDATE") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "seq long, event_at double, kind string")
    got = {span: sorted((r.seq, r.run) for r in channel.failure_runs(df, 50.0, 300.0, span).collect()) for span in (7, 64, 10_000)}
    assert got[7] == got[64] == got[10_000] and max(n for _, n in got[7]) > 200


def test_deletions_asked_for_leave_fewer_ghosts(spark):
    ghosts = {(r.vendor, r.arm): r.ghost for r in catalog.QUERIES["deletion_ladder"](spark, SF).collect()}
    for vendor in ("atlas", "beacon"):
        assert ghosts[vendor, "3 overlap_300"] > 50 and ghosts[vendor, "4 deletions"] <= ghosts[vendor, "3 overlap_300"] // 10


def test_both_channels_miss_least(spark):
    missed = {r.arm: r.n_missed for r in catalog.QUERIES["channel_arms"](spark, SF).collect()}
    assert missed["both"] < missed["webhook"] < missed["poll"] and missed["both"] < missed["both_outage"]


def test_first_reads_of_what_an_outage_leaves_against_brute_force(spark):
    import random

    from tidemark.operators import detect

    rng = random.Random(9)
    changes = [(i, rng.choice(["UPDATE", "DELETE"]), rng.randrange(4), float(rng.randrange(50)), i % 3 == 0) for i in range(120)]
    hooks = [(rng.randrange(4), float(rng.randrange(60)), rng.random() < 0.5) for _ in range(60)]
    polls, tells = ([(rng.randrange(4), float(rng.randrange(60))) for _ in range(n)] for n in (30, 10))
    read = lambda rows, more="": spark.createDataFrame(rows, f"record_id long, at double{more}")
    asked = spark.createDataFrame(changes, "seq long, kind string, record_id long, event_at double, last boolean")
    rows = detect.first_reads(asked, read(hooks, ", left boolean"), read(polls), read(tells))
    arms = spark.createDataFrame([("all", True, True, False), ("outage", True, True, True)], "arm string, hook boolean, poll boolean, outage boolean")
    want = []
    for seq, kind, record, t, last in changes:
        first = lambda found: min((at for r, at, *_ in found if r == record and at >= t), default=None)
        poll = first(tells if kind == "DELETE" else polls)
        for arm, found in (("all", hooks), ("outage", [h for h in hooks if h[2]])):
            times = [x for x in (first(found), poll) if x is not None and x <= 40.0]
            want.append((arm, seq, min(times) - t if times else None, last))
    got = detect.credited(rows, arms, 40.0, "last").select("arm", "seq", "latency", "last").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
