"""Reconciliation strategies between upstream rows and a local copy, with their call costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import bucket


def drift(truth: DataFrame, local: DataFrame) -> DataFrame:
    """(id, drift_kind): missing, ghost or wrong (another version)."""
    both = truth.select("id", F.col("version").alias("t")).join(local.select("id", F.col("version").alias("l")), "id", "full_outer")
    kind = F.when(F.col("l").isNull(), "missing").when(F.col("t").isNull(), "ghost").when(F.col("t") != F.col("l"), "wrong")
    return both.select("id", kind.alias("drift_kind")).where("drift_kind is not null")


def checksums(df: DataFrame, partitions: int) -> DataFrame:
    """(bucket, n, checksum) of the ids in each hash partition: an order-free sum of their draws and
    a count, so that no partition's ids are ever strung together in one task."""
    each = df.select(bucket("part", "id", partitions).alias("bucket"), bucket("sum1", "id", 1 << 31).alias("a"), bucket("sum2", "id", 1 << 31).alias("b"))
    return each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def differing(truth: DataFrame, local: DataFrame, partitions: int) -> DataFrame:
    """Buckets whose checksums differ."""
    t, s = checksums(truth, partitions).toDF("bucket", "tn", "ta", "tb"), checksums(local, partitions).toDF("bucket", "ln", "la", "lb")
    both = t.join(s, "bucket", "full_outer")
    return both.where("not (tn <=> ln and ta <=> la and tb <=> lb)").select("bucket", F.coalesce("tn", F.lit(0)).alias("upstream_n"), F.coalesce("ln", F.lit(0)).alias("local_n"))


def membership(truth: DataFrame, local: DataFrame) -> DataFrame:
    """(id, drift_kind) that comparing ids alone can see."""
    missing = truth.join(local, "id", "left_anti").select("id", F.lit("missing").alias("drift_kind"))
    return missing.union(local.join(truth, "id", "left_anti").select("id", F.lit("ghost").alias("drift_kind")))


#: The strategies in order of what they can see.
STRATEGIES = ("none", "count_check", "partitioned_checksum", "full_id_inventory", "full_field_compare")


def matrix(truth: DataFrame, local: DataFrame, partitions: int = 40, id_page: int = 1000, batch: int = 200) -> DataFrame:
    """One row per strategy: calls, drift present, detected, missed, rate, calls per 1,000 rows and
    detections per call (null without calls).

    One full outer join and one aggregate per bucket serve all. What the checksums detect is the
    membership drift in buckets whose sums differ; a count only tells that there is some.
    """
    n = bucket("part", "id", partitions)
    one, two = (bucket(tag, "id", 1 << 31) for tag in ("sum1", "sum2"))
    both = truth.select("id", F.col("version").alias("t")).join(local.select("id", F.col("version").alias("l")), "id", "full_outer")
    both = both.select(n.alias("bucket"), one.alias("a"), two.alias("b"), F.col("t").isNotNull().cast("int").alias("up"), F.col("l").isNotNull().cast("int").alias("down"), (F.col("t") != F.col("l")).alias("wrong"))
    sums = [F.sum(F.col(c) * (F.col("up") - F.col("down"))).alias(c) for c in ("a", "b")]
    each = both.groupBy("bucket").agg(F.sum("up").alias("n"), F.sum("down").alias("m"), *sums, F.count_if(F.col("up") != F.col("down")).alias("moved"), F.count_if("wrong").alias("wrong"))
    differs = F.col("n").eqNullSafe(F.col("m")) & (F.col("a") == 0) & (F.col("b") == 0)
    total = each.agg(
        F.sum("n").alias("n"), F.count_if(~differs).alias("bad"), F.sum("moved").alias("moved"), F.sum("wrong").alias("wrong"),
        F.sum(F.when(~differs, F.col("moved")).otherwise(0)).alias("in_bad"))
    calls = (F.lit(0), F.lit(1), F.lit(partitions) + F.col("bad"), F.floor(F.col("n") / id_page) + 1, F.ceil(F.col("n") / batch))
    seen = (F.lit(0), F.lit(0), F.col("in_bad"), F.col("moved"), F.col("moved") + F.col("wrong"))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), c.cast("long").alias("calls"), d.cast("long").alias("detected")) for s, c, d in zip(STRATEGIES, calls, seen, strict=True))))
    one = total.select("n", (F.col("moved") + F.col("wrong")).alias("present"), rows.alias("s")).select("n", "present", "s.*")
    return one.select(
        "strategy", "calls", "present", "detected", (F.col("present") - F.col("detected")).alias("missed"),
        F.bround(F.coalesce(F.try_divide("detected", "present"), F.lit(0.0)), 6).alias("rate"), F.bround(1000 * F.col("calls") / F.col("n"), 6).alias("calls_per_1k"),
        F.bround(F.try_divide("detected", "calls"), 6).alias("detected_per_call"))
