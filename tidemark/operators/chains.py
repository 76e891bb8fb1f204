"""Ends of chains of pointers by doubling: as many rounds as the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stage import written


def ends(pointers: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, hops): the last row that each source's chain of pointers leads to.

    A source points to one target, and chains don't come back on themselves. Each round replaces a
    pointer by its target's own, so that it reaches twice as far; rows whose target points nowhere
    are done and not joined again. A round's rows are written, so that plans don't grow.
    """
    now = pointers.select(source, target, F.lit(1).cast("long").alias("hops"), F.lit(False).alias("__done"))
    while True:
        on = now.select(F.col(source).alias("__s"), F.col(target).alias("__t"), F.col("hops").alias("__h"))
        ahead = now.where("not __done").join(on, F.col(target) == F.col("__s"), "left").select(
            source, F.coalesce("__t", target).alias(target), (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"), F.col("__s").isNull().alias("__done"))
        now = written(ahead.unionByName(now.where("__done")), "chains")
        if now.where("not __done").isEmpty():
            return now.drop("__done")
