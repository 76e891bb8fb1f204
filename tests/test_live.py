"""Stores, sources, backfills, trees, chains, instants, keyed state and stream joins on small tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalog_arms, catalog_live
from tidemark.operators import asof, backfill, chains, digest, report, scan, sync
from tidemark.plans.stage import new_path
from tidemark.sources import results, vendor
from tidemark.streaming import joins, state, store
from tidemark.streaming.feed import fed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def published(spark):
    vendor.register(spark)
    path = new_path(spark, "vendor")
    vendor.publish(spark.range(100).select("id", (F.col("id") * 1.5).alias("last_modified"), F.lit("x").alias("v")), path, per_range=10)
    return path


def test_bounds_reach_the_vendors_ranges(spark, published):
    rows = spark.read.format(vendor.NAME).load(published).where("last_modified >= 100 and last_modified < 120 and v = 'x'")
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThanOrEqual(last_modified,100.0), LessThan(last_modified,120.0)]" in plan
    assert rows.rdd.getNumPartitions() <= 3 < spark.read.format(vendor.NAME).load(published).rdd.getNumPartitions()
    assert sorted(r.id for r in rows.collect()) == list(range(67, 80))
    assert [r.id for r in spark.read.format(vendor.NAME).load(published).where("id = 7").collect()] == [7]
    assert spark.read.format(vendor.NAME).load(published).where("last_modified > 1e9").count() == 0


def test_a_publication_without_listing_is_not_seen(spark, published):
    spark.range(5).select("id", F.lit(1e6).alias("last_modified"), F.lit("y").alias("v")).write.parquet(f"{published}/ranges/broken")
    assert spark.read.format(vendor.NAME).load(published).count() == 100


def test_reads_are_those_of_all_passes(spark):
    """Against the definition: every version at every pass, filtered."""
    versions = catalog_arms._versions(spark, SF, catalog_arms._changes(spark, SF))
    arms = catalog_arms._arms(spark, [("a", 0.0, False, False), ("b", 120.0, True, False), ("c", 1800.0, True, False)])
    for archived in (False, True):
        live = scan.at_passes(versions.where(F.lit(archived) | ~F.col("tombstone")), 300.0, 96)
        marks = sync.watermarks(versions, 300.0, 96, archived).select("pass_no", "lower")
        bound = F.col("lower") - F.col("overlap") + F.when(F.col("inclusive"), 0.0).otherwise(sync.EPSILON)
        want = live.join(marks, "pass_no").crossJoin(arms).where(F.col("last_modified") >= bound).select("arm", "pass_no", "id", "version")
        got = sync.reads(versions, arms, 300.0, 96, archived).select("arm", "pass_no", "id", "version")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deletions_are_told_once_and_forgotten(spark):
    versions = spark.createDataFrame([(1, 0.0, None, 5.0, False), (2, 650.0, None, 640.0, False)], "id long, valid_from double, valid_to double, last_modified double, tombstone boolean")
    deaths = spark.createDataFrame([(10, 1.0), (11, 299.0), (12, 300.0), (13, 1000.0), (14, 1250.0), (15, 5000.0)], "id long, at double")
    arms = spark.createDataFrame([("a", 60.0), ("b", 60.0)], "arm string, overlap double")
    failed = spark.createDataFrame([("b", 1), ("b", 4), ("b", 5)], "arm string, pass_no int")
    got = sync.deletions_told(deaths, versions, arms, 300.0, 6, 400.0, failed)
    told = {(r.arm, r.id): r.pass_no for r in got.collect()}
    assert told[("a", 13)] == 4 and told[("a", 14)] == 5 and ("a", 15) not in told
    assert told[("a", 10)] == told[("a", 11)] == told[("a", 12)] == 1
    assert told[("b", 11)] == told[("b", 12)] == 2 and ("b", 10) not in told  # asked for again, 1 is forgotten by then
    assert ("b", 13) not in told and ("b", 14) not in told


def test_interrupted_backfill_equals_a_whole_one(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, float(rng.randrange(7)), None if i % 9 else "x") for i in range(500)], "id long, last_modified double, v string")
    folder = new_path(spark, "backfill")
    for budget, fails in ((1, 2), (3, None), (0, 4)):
        backfill.attempt(rows, folder, "last_modified", "id", 45, budget, fails)
        assert backfill.watermark(spark, folder, 7.0) is None
    assert backfill.committed(spark, folder).count() == 4
    backfill.attempt(rows, folder, "last_modified", "id", 45)
    backfill.attempt(rows, folder, "last_modified", "id", 45)
    assert backfill.watermark(spark, folder, 7.0) == 7.0
    assert sorted(map(tuple, backfill.copied(spark, folder, rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    assert {r.range: r.n for r in backfill.committed(spark, folder).collect()} == {k: 45 for k in range(11)} | {11: 5}


def test_digest_tree_keeps_order_and_finds_what_differs(spark):
    rows = [(k, "a" if k % 3 else None) for k in range(0, 9000, 7)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    nodes = digest.tree(df, "k", ["v"], levels=3)
    found = {(r.level, r.node): (r.n, r.digest) for r in nodes.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {}
    for k, v in rows:
        level.setdefault(k // 256, []).append(sha(f"={k}|" + ("-" if v is None else f"={v}")))
    want = {(0, n): (len(d), sha("".join(d))) for n, d in level.items()}
    now = {n: want[0, n] for n in level}
    for i in (1, 2, 3):
        up = {}
        for n in sorted(now):
            up.setdefault(n // 16, []).append(now[n])
        now = {n: (sum(c for c, _ in x), sha("".join(d for _, d in x))) for n, x in up.items()}
        want |= {(i, n): x for n, x in now.items()}
    assert found == want
    other = digest.tree(df.where("k <> 700").union(spark.createDataFrame([(8000, "b")], "k long, v string")), "k", ["v"], levels=3)
    asked = digest.descent(nodes, other, levels=3).where("differs and level = 0").collect()
    assert {r.node for r in asked} == {700 // 256, 8000 // 256}
    assert digest.descent(nodes, nodes, levels=3).count() == 1


def test_chains_end_where_a_loop_ends(spark):
    rng = random.Random(2)
    to = {i: rng.randrange(i + 1, 1000) for i in range(0, 900) if rng.random() < 0.8} | {i: i + 1 for i in range(2000, 2300)} | {i: 5000 for i in range(3000, 3400)}
    got = {r.a: (r.b, r.hops) for r in chains.ends(spark.createDataFrame(list(to.items()), "a long, b long"), "a", "b").collect()}
    for a in to:
        b, hops = to[a], 1
        while b in to:
            b, hops = to[b], hops + 1
        assert got.pop(a) == (b, hops)
    assert not got
    assert chains.ends(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_instants_meet_the_version_that_holds(spark):
    rng = random.Random(3)
    versions, asked = [], []
    for key in range(30):
        cuts = sorted(rng.uniform(-5, 600) for _ in range(rng.randrange(1, 300 if key == 0 else 6)))
        versions += [(key, a, b, i) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], None if key % 2 else 650.0]))]
        asked += [(key, t) for t in [rng.uniform(-10, 700) for _ in range(400 if key == 0 else 10)] + cuts[:3]]
    got = asof.join(
        spark.createDataFrame(asked, "k long, t double"), spark.createDataFrame(versions, "k long, a double, b double, i long"), "k", "t", "a", "b", leaf=1.0, levels=4)
    want = [(k, t, a, b, i) for k, t in asked for v, a, b, i in versions if v == k and a <= t and (b is None or t < b)]
    assert sorted(map(tuple, got.select("k", "t", "a", "b", "i").collect()), key=repr) == sorted(want, key=repr)


def test_only_hot_keys_go_by_cells(spark, monkeypatch):
    """Overlaps and instants of keys with few and many versions; few ones are never put into cells."""
    rng = random.Random(6)
    versions = [(k, a, rng.choice([None, a + rng.uniform(0, 200)]), i) for k, n in ((1, 3), (2, asof.FEW), (3, asof.FEW + 1), (4, 1)) for i, a in enumerate(rng.uniform(0, 500) for _ in range(n))]
    asked = [(k, rng.uniform(0, 600)) for k in (1, 2, 3, 5) for _ in range(20)]
    cells = asof._cells
    monkeypatch.setattr(asof, "_cells", lambda *a: F.array(F.struct(F.lit(0).alias("level"), F.raise_error(F.lit("cells")).cast("long").alias("cell"))) if few else cells(*a))
    for few in (False, True):
        own = [v for v in versions if v[0] != 3 or not few]
        got = asof.join(spark.createDataFrame(asked, "k long, t double"), spark.createDataFrame(own, "k long, a double, b double, i long"), "k", "t", "a", "b", leaf=1.0, levels=4)
        want = [(k, t, a, b, i) for k, t in asked for v, a, b, i in own if v == k and a <= t and (b is None or t < b)]
        assert sorted(map(tuple, got.select("k", "t", "a", "b", "i").collect()), key=repr) == sorted(want, key=repr)


def test_store_survives_a_merge_that_dies(spark, monkeypatch):
    path = new_path(spark, "store")
    rows = lambda ids, v, x: spark.createDataFrame([(i, v, x) for i in ids], "k long, v long, x string")
    first = store.merge(rows(range(100), 1, "a"), path, "k", "v", buckets=8)
    held = sorted(map(tuple, store.read(spark, path).collect()))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        with pytest.raises(OSError):
            store.merge(rows([1, 2], 2, "b"), path, "k", "v")
    assert sorted(map(tuple, store.read(spark, path).collect())) == held and store.versions(spark, path) == [1]
    second = store.merge(rows([1, 2], 2, "b"), path, "k", "v", batch=0)
    assert store.merge(rows([1, 2], 9, "z"), path, "k", "v", batch=0) == second
    changed = [b for b, f in second.folders.items() if first.folders[b] != f]
    assert 1 <= len(changed) <= 2
    now = {r.k: (r.v, r.x) for r in store.merge(rows([2], 1, "old"), path, "k", "v") and store.read(spark, path).collect()}
    assert now[1] == now[2] == (2, "b") and now[3] == (1, "a") and len(now) == 100
    assert sorted(map(tuple, store.read(spark, path, 1).collect())) == held
    with pytest.raises(RuntimeError):
        store._commit(spark, path, store.manifest(spark, path))
    assert store.vacuum(spark, path) >= 2
    assert {r.k: (r.v, r.x) for r in store.read(spark, path).collect()} == now


def test_results_come_back_and_broken_ones_are_kept_aside(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, [(1, "x"), (2, None)]), ("b", None, [])], "name string, score double, parts array<struct<n:long,said:string>>")
    path = str(tmp_path / "results")
    results.write(rows, "name", path)
    (tmp_path / "results" / "broken.json").write_text('{"name": "c", "score": ')
    whole, broken = results.read(spark, path, rows.schema)
    assert sorted((r["name"], r.score, [tuple(p) for p in r.parts]) for r in whole.collect()) == [("a", 1.5, [(1, "x"), (2, None)]), ("b", None, [])]
    assert [r.file.rsplit("/", 1)[1] for r in broken.collect()] == ["broken.json"]
    text = next((tmp_path / "results" / "name=a").glob("*.txt")).read_text()
    assert json.loads(text)["name"] == "a" and text.count("\n") > 5


def moments(spark, rows, names):
    return spark.createDataFrame(rows, names).withColumn("at", F.timestamp_seconds("t"))


def test_arrivals_are_forgotten_after_their_time(spark):
    parts = [moments(spark, rows, "k string, t long") for rows in ([("a", 10), ("a", 12), ("b", 11)], [("a", 40), ("c", 500)], [("a", 505), ("b", 506)], [("z", 5000)])]
    with state.rocksdb(spark):
        rows, progress = fed(spark, lambda s: state.first_arrivals(s, "k", "at", "5 seconds", 100_000), parts)
    assert sorted((r.k, r.t) for r in rows.collect()) == [("a", 10), ("a", 505), ("b", 11), ("b", 506), ("c", 500), ("z", 5000)]
    assert progress[-1].stateOperators[0].numRowsTotal <= 4


def test_arrivals_are_remembered_by_the_bucket(spark):
    """However many keys there are, state has a few rows a bucket; one bucket gives what many do."""
    rng = random.Random(4)
    rows = [[(f"k{rng.randrange(p * 60, p * 60 + 90)}", 1000 + p * 300 + rng.randrange(300)) for _ in range(200)] for p in range(3)]
    parts = [moments(spark, r, "k string, t long") for r in rows]
    found = []
    for buckets in (1, 7):
        with state.rocksdb(spark):
            out, progress = fed(spark, lambda s, n=buckets: state.first_arrivals(s, "k", "at", "5 seconds", 200_000, n), parts)
        found.append(sorted((r.k, r.t) for r in out.collect()))
        assert max(p.stateOperators[0].numRowsTotal for p in progress) <= 3 * buckets
    assert found[0] == found[1]
    first = {}
    for k, t in rows[0]:
        first[k] = min(t, first.get(k, t))
    assert {k: t for k, t in found[0] if t < 1300} == first


def test_a_disabled_subscription_stays_so_over_restarts(spark):
    rows = [(s, i, i >= 3 if s else i % 2 == 0) for i in range(12) for s in (0, 1)]
    parts = [spark.createDataFrame([r for r in rows if r[1] // 4 == k], "subscription long, seq long, down boolean") for k in range(3)]
    with state.rocksdb(spark):
        found, _ = fed(spark, lambda s: state.failure_runs(s, 5), parts)
    got = {(r.subscription, r.seq): (r.run, r.disabled) for r in found.collect()}
    assert [got[1, i] for i in range(12)] == [(0, False)] * 3 + [(n, n >= 5) for n in (1, 2, 3, 4, 5, 5, 5, 5, 5)]
    assert all(got[0, i] == (int(i % 2 == 0), False) for i in range(12))


def test_joined_streams_hold_only_what_may_still_meet(spark):
    rows = [[(i, i % 5, i + 1000) for i in range(k * 200, k * 200 + 200)] for k in range(4)]
    changes = [moments(spark, r, "seq long, record_id long, t long").withColumnRenamed("at", "changed") for r in rows]
    hints = [moments(spark, [(i % 5, t + 3) for i, _, t in r if i % 7], "record_id long, t long").withColumnRenamed("at", "hinted") for r in rows]
    found, progress = fed(spark, lambda c, h: joins.hinted(c.drop("t"), h.drop("t"), "10 seconds", "5 seconds"), changes, hints)
    assert max(p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators) <= 500
    assert max(p.stateOperators[0].numRowsTotal for p in progress[-1:]) <= 80
    got = {}
    for r in found.collect():
        got.setdefault(r.seq, set()).add(None if r.hinted is None else int(r.hinted.timestamp()) - 1000)
    for i in range(700):
        want = {j + 3 for j in range(max(0, i - 3), min(800, i + 8)) if j % 7 and j % 5 == i % 5 and i <= j + 3 <= i + 10}
        assert got[i] == (want or {None})


def test_late_rows_are_there_and_counted(spark):
    row = catalog_live.stream_late_rows(spark, SF).first()
    assert 0 < row.n_dropped == row.n_missing < row.n_sent // 10


def test_charts_of_too_few_bars_fail_and_counts_have_nouns(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1234567)], "k string, n long")
    assert report.bars(rows, "k", "n", expected=2).count() == 2
    with pytest.raises(Exception, match="3 bars expected, found 2"):
        report.bars(rows, "k", "n", expected=3).collect()
    assert [r.s for r in rows.orderBy("k").select(report.counted(F.col("n"), "call").alias("s")).collect()] == ["1 call", "1,234,567 calls"]
