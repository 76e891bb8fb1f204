"""A backfill by keyset ranges that can stop anywhere and go on: bounds once, a commit per range.

The folder of a backfill holds ``bounds`` (the ranges, drawn once), ``rows/range=k`` and, for each
range whose rows are all there, ``done/range=k``. There is no watermark until every range is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def plan(rows: DataFrame, folder: str, stamp: str, key: str, per_range: int) -> DataFrame:
    """(range, low_stamp, low_key, high_stamp, high_key): ranges of per_range rows in (stamp, key)
    order, each from above one cursor up to another; those that an earlier attempt drew, if any."""
    spark = rows.sparkSession
    if not _there(spark, f"{folder}/bounds/_SUCCESS"):
        cut = numbered(rows.select(stamp, key), [stamp, key]).withColumn("range", F.floor((F.col("rn") - 1) / per_range).cast("long"))
        ends = cut.groupBy("range").agg(F.max(F.struct(F.col(stamp).alias("stamp"), F.col(key).alias("key"))).alias("high"))
        before = ends.select((F.col("range") + 1).alias("range"), F.col("high").alias("low"))
        ends.join(before, "range", "left").write.mode("overwrite").parquet(f"{folder}/bounds")
    bounds = spark.read.parquet(f"{folder}/bounds")
    return bounds.select("range", *(F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("low", "high") for c in ("stamp", "key")))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(range, n): the ranges that are done, and how many rows each has."""
    if not _there(spark, f"{folder}/done"):
        return spark.createDataFrame([], "range long, n long")
    return spark.read.schema("range long, n long").parquet(f"{folder}/done").select("range", "n")


def attempt(rows: DataFrame, folder: str, stamp: str, key: str, per_range: int, budget: int | None = None, fails: int | None = None) -> None:
    """Read and commit the next ``budget`` ranges (all if null) that aren't committed.

    fails: this many ranges more are read, and then the attempt ends without committing them, as a
    lost call does. Rows of ranges are written first and committed by a listing of their own; what
    a failed attempt has written isn't read by anyone and is overwritten by the next.
    """
    spark = rows.sparkSession
    left = plan(rows, folder, stamp, key, per_range).join(committed(spark, folder), "range", "left_anti").orderBy("range")
    taken = left if budget is None else left.limit(budget + (fails or 0))
    numbers = [r["range"] for r in taken.select("range").collect()]  # one number a range, of those taken
    if not numbers:
        return
    part = assigned(rows, taken, len(numbers), stamp, key)
    part.repartition("range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{folder}/rows")
    kept = numbers if budget is None else numbers[:budget]
    if kept:
        written = spark.read.option("basePath", f"{folder}/rows").parquet(*(f"{folder}/rows/range={k}" for k in kept))
        written.groupBy(F.col("range").cast("long").alias("range")).agg(F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{folder}/done")


def assigned(rows: DataFrame, ranges: DataFrame, n: int, stamp: str, key: str) -> DataFrame:
    """rows of any of n ranges, with its number: a binary search among the ranges' upper cursors,
    which are one broadcast row of n entries, in a built-in fold."""
    cursor = lambda end: F.struct(F.col(f"{end}_stamp").alias("stamp"), F.col(f"{end}_key").alias("key"))
    one = ranges.select(F.struct(cursor("high").alias("high"), cursor("low").alias("low"), F.col("low_stamp").isNull().alias("open"), "range").alias("r"))
    one = one.agg(F.sort_array(F.collect_list("r")).alias("__ranges"))
    at = F.struct(F.col(stamp).alias("stamp"), F.col(key).alias("key"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s, _):
        below = F.get("__ranges", middle(s))["high"] < at
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle(s)).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve)["lo"]
    out = rows.crossJoin(F.broadcast(one)).withColumn("__r", F.get("__ranges", found))
    return out.where(F.col("__r").isNotNull() & (F.col("__r.open") | (at > F.col("__r.low")))).select(*rows.columns, F.col("__r.range").alias("range"))


def watermark(spark: SparkSession, folder: str, started: float) -> float | None:
    """The time that the backfill started if all its ranges are done, else null: an incremental pass
    after it must then read everything."""
    bounds = spark.read.parquet(f"{folder}/bounds")
    return started if bounds.join(committed(spark, folder), "range", "left_anti").isEmpty() else None


def copied(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of committed ranges."""
    rows = spark.read.schema(schema.add("range", "long")).parquet(f"{folder}/rows")
    return rows.join(committed(spark, folder).select("range"), "range", "left_semi").drop("range")
