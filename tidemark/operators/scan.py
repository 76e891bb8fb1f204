"""Scans of an upstream table: modified-since, keyset cursors, pages, ceilings, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.stage import written


def modified_since(df: DataFrame, stamp: str, key: str, since, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Rows with stamp >= since in (stamp, key) order, after a cursor if given; one page if limited.

    The bound is a plain filter that reaches the scan; a page is a TakeOrderedAndProject.
    """
    out = df.where(F.col(stamp) >= F.lit(since))
    if after is not None:
        out = out.where((F.col(stamp) > F.lit(after[0])) | ((F.col(stamp) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    if limit is not None:
        out = out.orderBy(stamp, key).limit(limit)
    return out


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with rn from 1 in the order given, within groups ``by``.

    Without groups the rows are dealt by ranges, which are written with their number, since a
    second dealing might draw other bounds: counts per range come first, so no task sees more than
    its range.
    """
    if by:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn("rn", (F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__i", "__before")


def pages(df: DataFrame, stamp: str, key: str, size: int) -> DataFrame:
    """df with page_no from 0: the page that a keyset-paginated scan returns a row on."""
    return numbered(df, [stamp, key]).withColumn("page_no", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def as_of(versions: DataFrame, t: float | Column) -> DataFrame:
    """The state of every record at t."""
    t = F.lit(t) if not isinstance(t, Column) else t
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def held_passes(interval: float, passes: int) -> tuple[Column, Column]:
    """The first and last of passes 1..passes at whose time, k * interval, a version holds."""
    first = F.greatest(F.lit(1), F.ceil(F.col("valid_from") / interval).cast("int"))
    last = F.when(F.col("valid_to").isNull(), F.lit(passes)).otherwise(F.least(F.lit(passes), (F.ceil(F.col("valid_to") / interval) - 1).cast("int")))
    return first, last


def at_passes(versions: DataFrame, interval: float, passes: int) -> DataFrame:
    """versions once for each pass k at whose time they hold: a range join written as an explode of
    the passes that an interval covers."""
    first, last = held_passes(interval, passes)
    return versions.where(first <= last).withColumn("pass_no", F.explode(F.sequence(first, last)))
