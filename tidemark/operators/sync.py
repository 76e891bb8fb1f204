"""Incremental sync: watermarks, what each pass reads, the local copy, and its score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import as_of, at_passes, held_passes

EPSILON = 1e-9


def watermarks(versions: DataFrame, interval: float, passes: int, archived: bool = False) -> DataFrame:
    """(pass_no, pass_max, watermark, lower): the running maximum of live stamps seen by passes,
    from 0 at the backfill; lower is the one that a pass starts from. One row per pass. archived:
    scans give archived rows too."""
    live = at_passes(versions.where((F.lit(archived) | ~F.col("tombstone")) & (F.col("last_modified") >= 0)), interval, passes)
    each = live.groupBy("pass_no").agg(F.max("last_modified").alias("pass_max"))
    spine = versions.sparkSession.range(1, passes + 1).select(F.col("id").cast("int").alias("pass_no"))
    w = Window.orderBy("pass_no")
    out = spine.join(F.broadcast(each), "pass_no", "left")
    running = F.greatest(F.lit(0.0), F.coalesce(F.max("pass_max").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    out = out.select("pass_no", "pass_max", running.alias("watermark"))
    return out.select("*", F.coalesce(F.lag("watermark").over(w), F.lit(0.0)).alias("lower"))


def bounds(versions: DataFrame, arms: DataFrame, interval: float, passes: int, archived: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """(arm, lowers): the watermark that each pass of an arm starts from, as an array in order.

    A pass in failed (arm, pass_no) reads, but doesn't move the watermark on. A version counts at
    the first pass that does and at whose time it holds: a running maximum needs no others, so that
    versions aren't multiplied by their passes. One row per arm and pass.
    """
    first, last = held_passes(interval, passes)
    seen = versions.where((F.lit(archived) | ~F.col("tombstone")) & (F.col("last_modified") >= 0)).select(first.alias("first"), last.alias("last"), "last_modified").where("first <= last")
    each = seen.groupBy("first", "last").agg(F.max("last_modified").alias("stamp"))  # a row per pair of passes at most
    plan = schedule(arms, passes, failed)
    moved = each.join(F.broadcast(plan.select("arm", F.col("pass_no").alias("first"), "works")), "first").where("works <= last")
    best = moved.groupBy("arm", F.col("works").alias("pass_no")).agg(F.max("stamp").alias("stamp"))
    before = Window.partitionBy("arm").orderBy("pass_no").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.greatest(F.lit(0.0), F.coalesce(F.max("stamp").over(before), F.lit(0.0)))
    rows = plan.select("arm", "pass_no").join(best, ["arm", "pass_no"], "left").select("arm", "pass_no", lower.alias("lower"))
    return rows.groupBy("arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass_no", "lower"))), lambda x: x["lower"]).alias("lowers"))


def schedule(arms: DataFrame, passes: int, failed: DataFrame | None = None) -> DataFrame:
    """(arm, pass_no, works): the first pass from pass_no on that doesn't fail, null if none does."""
    spine = arms.select("arm").crossJoin(F.broadcast(arms.sparkSession.range(1, passes + 1).select(F.col("id").cast("int").alias("pass_no"))))
    bad = F.lit(None).cast("boolean")
    if failed is not None:
        spine = spine.join(F.broadcast(failed.select("arm", "pass_no", F.lit(True).alias("bad"))), ["arm", "pass_no"], "left")
        bad = F.col("bad")
    after = Window.partitionBy("arm").orderBy("pass_no").rowsBetween(0, Window.unboundedFollowing)
    return spine.select("arm", "pass_no", F.min(F.when(bad.isNull(), F.col("pass_no"))).over(after).alias("works"))


def reads(versions: DataFrame, arms: DataFrame, interval: float, passes: int, archived: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """(arm, pass_no, id, version, last_modified): live rows that a pass of an arm reads; if
    archived, archived rows too, and tombstone.

    arms (arm, overlap, inclusive) and their watermarks are one row per arm. Watermarks never fall,
    so an arm's passes read a version up to the last one whose bound its stamp meets: only these
    rows are made.
    """
    deepest = arms.agg(F.max("overlap")).first()[0] or 0.0
    live = versions.where((F.lit(archived) | ~F.col("tombstone")) & (F.col("last_modified") >= -float(deepest)))
    first, last = held_passes(interval, passes)
    asks = arms.join(bounds(versions, arms, interval, passes, archived, failed), "arm")
    epsilon = F.when(F.col("inclusive"), 0.0).otherwise(EPSILON)
    rows = live.select("id", "version", "last_modified", "tombstone", first.alias("first"), last.alias("last")).where("first <= last").crossJoin(F.broadcast(asks))
    # how many passes' bounds the stamp meets, by halving: a column a step, so that each is compiled
    rows = rows.withColumn("met", F.lit(0))
    for step in (1 << k for k in reversed(range(passes.bit_length()))):
        bound = F.get("lowers", F.col("met") + (step - 1)) - F.col("overlap") + epsilon
        rows = rows.withColumn("met", F.col("met") + F.when(F.col("last_modified") >= bound, step).otherwise(0))
    upto = F.least(F.col("last"), F.col("met"))
    read = F.when(F.col("first") <= upto, F.sequence("first", upto)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("pass_no", F.explode(read))
    return rows.select("arm", "pass_no", "id", "version", "last_modified", *["tombstone"] * archived)


def deletions_told(deaths: DataFrame, versions: DataFrame, arms: DataFrame, interval: float, passes: int, retention: float, failed: DataFrame | None = None) -> DataFrame:
    """(arm, id, pass_no): the pass that learns of a deletion (id, at) from an endpoint which it asks
    for [its watermark less the overlap, now] and which forgets after ``retention`` seconds.

    A pass in failed (arm, pass_no) isn't answered and leaves its watermark, so that the next one
    asks again. Bounds only rise: the first pass that is answered decides, one lookup a deletion.
    """
    asks = arms.join(bounds(versions, arms, interval, passes, False, failed), "arm").join(schedule(arms, passes, failed), "arm")
    first = F.greatest(F.lit(1), F.ceil(F.col("at") / interval).cast("int"))
    rows = deaths.withColumn("pass_no", first).join(F.broadcast(asks), "pass_no").where("works is not null")
    lower, now = F.element_at("lowers", F.col("works")) - F.col("overlap"), F.col("works") * F.lit(float(interval))
    return rows.where((F.col("at") >= lower) & (F.col("at") >= now - retention)).select("arm", "id", F.col("works").alias("pass_no"))


def without_deleted(local: DataFrame, arms: DataFrame, deletes: DataFrame) -> DataFrame:
    """local without the records that deletes (arm, id) tell of, in arms that ask for deletions."""
    asks = deletes.join(F.broadcast(arms.where("deletes").select("arm")), "arm", "left_semi")
    return local.join(asks, ["arm", "id"], "left_anti")


def guarded_watermarks(marks: DataFrame, failed: DataFrame) -> DataFrame:
    """(pass_no, lower) where a pass in failed(pass_no) doesn't move the watermark on, though it
    has read: the next one starts where the last success left it; null, a full scan, before any.

    marks (pass_no, pass_max) has one row per pass."""
    w = Window.orderBy("pass_no").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col("bad").isNull(), F.greatest(F.lit(0.0), F.coalesce("pass_max", F.lit(0.0))))
    out = marks.join(F.broadcast(failed.select("pass_no", F.lit(True).alias("bad"))), "pass_no", "left")
    return out.select("pass_no", F.max(moved).over(w).alias("lower"))


def local_copy(recs: DataFrame, read: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, id, version): the version of the last read, else the backfill's."""
    last = read.groupBy("arm", "id").agg(F.max_by("version", "pass_no").alias("version"))
    every = recs.select("id").crossJoin(F.broadcast(arms.select("arm")))
    return every.join(last, ["arm", "id"], "left").select("arm", "id", F.coalesce("version", F.lit(1).cast("long")).alias("version"))


def compare(truth: DataFrame, local: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, id, state): correct, stale, missing or ghost; truth (id, version) are live rows, arms
    has a row per arm."""
    arms = arms.select("arm")
    want = truth.select("id", F.col("version").alias("true_version")).crossJoin(F.broadcast(arms))
    return states(want.join(local, ["arm", "id"], "full_outer"))


def states(both: DataFrame) -> DataFrame:
    """(arm, id, state) of rows (arm, id, true_version, version), nulls where a side has none."""
    state = (
        F.when(F.col("true_version").isNull(), "ghost").when(F.col("version").isNull(), "missing")
        .when(F.col("version") == F.col("true_version"), "correct").otherwise("stale")
    )
    return both.select("arm", "id", state.alias("state"))


def score(compared: DataFrame) -> DataFrame:
    """Counts per arm, accuracy over upstream live rows and over rows held locally."""
    n = {s: F.count_if(F.col("state") == s) for s in ("correct", "stale", "missing", "ghost")}
    out = compared.groupBy("arm").agg(*(c.alias(s) for s, c in n.items()))
    live, held = F.expr("correct + stale + missing"), F.expr("correct + stale + ghost")
    return out.select(
        "arm", "correct", "stale", "missing", "ghost", F.expr("stale + missing + ghost").alias("wrong"),
        F.bround(F.col("correct") / live, 6).alias("accuracy"), F.bround(F.col("correct") / held, 6).alias("held_accuracy"))


def truth_at(versions: DataFrame, t: float) -> DataFrame:
    return as_of(versions, t).where("not tombstone").select("id", "version")


def redundant(read: DataFrame) -> DataFrame:
    """(arm, n_redundant): reads that brought a version already held."""
    w = Window.partitionBy("arm", "id").orderBy("pass_no")
    held = F.coalesce(F.lag("version").over(w), F.lit(1).cast("long"))
    return read.withColumn("again", held == F.col("version")).groupBy("arm").agg(F.count_if("again").alias("n_redundant"))
