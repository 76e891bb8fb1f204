"""Exact nearest-rank percentiles with half-even rounding of the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_index(p: float, n: Column) -> Column:
    """0-based index of the p-th percentile among n sorted values."""
    k = F.bround(F.lit(p / 100.0) * n.cast("double") + 0.5, 0).cast("long") - 1
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, k))


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float], slack: float = 0.001) -> DataFrame:
    """One row per group with n and p<at> columns, without ranking a whole group in one task.

    Approximate percentiles bracket each rank; values below a bracket are counted, and only the
    distinct values within it are put in order. ``by`` has no nulls.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v"))
    ends = [min(1.0, max(0.0, p / 100 + side * slack)) for p in at for side in (-1, 1)]
    approx = F.percentile_approx("v", F.array(*(F.lit(e) for e in ends)), F.lit(int(4 / slack)))
    sized = rows.groupBy(*by).agg(F.count("*").alias("n"), approx.alias("ends"))
    cuts = F.array(*(
        F.struct(F.lit(i).alias("p"), rank_index(p, F.col("n")).alias("k"), F.get("ends", F.lit(2 * i)).alias("lo"), F.get("ends", F.lit(2 * i + 1)).alias("hi"))
        for i, p in enumerate(at)))
    cut = sized.select(*by, "n", F.explode(cuts).alias("c")).select(*by, "n", "c.*")
    near = rows.join(cut, by).where("v <= hi").groupBy(*by, "n", "p", "k", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("x")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by, "p").orderBy(F.col("x").asc_nulls_first()))
    found = near.withColumn("upto", upto).where("x is not null and upto > k").groupBy(*by, "n", "p").agg(F.min("x").alias("x"))
    return found.groupBy(*by, "n").agg(*(F.max(F.when(F.col("p") == i, F.col("x"))).alias(f"p{p:g}") for i, p in enumerate(at)))
