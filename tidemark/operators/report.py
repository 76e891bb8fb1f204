"""Text rows for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(df: DataFrame, label: str, value: str, width: int = 44, expected: int | None = None) -> DataFrame:
    """(label, line): a proportional bar, at least one mark for any positive value. df is a report's
    few rows, so one window spans them. A chart of other than ``expected`` rows fails."""
    every = Window.partitionBy()
    if expected is not None:
        wrong = F.raise_error(F.concat(F.lit(f"{expected} bars expected, found "), F.count("*").over(every).cast("string")))
        df = df.withColumn(label, F.when(F.count("*").over(every) == expected, F.col(label)).otherwise(wrong.cast("string")))
    top = F.max(value).over(every)
    marks = F.when((F.col(value) == 0) | (top == 0), 0).otherwise(F.greatest(F.lit(1), F.bround(width * F.col(value) / top, 0).cast("int")))
    wide = F.max(F.length(label)).over(every)
    bar = F.expr(f"rpad(repeat('#', __marks), {width}, ' ')")
    out = df.withColumn("__marks", marks.cast("int")).withColumn("__wide", wide)
    line = F.concat(F.expr(f"rpad({label}, __wide, ' ')"), F.lit("  "), bar, F.lit(" "), F.col(value).cast("string"))
    return out.select(F.col(label).alias("label"), line.alias("line"))


def counted(n: Column, noun: str) -> Column:
    """A count with its noun: thousands apart, and an s unless it is one."""
    return F.concat(F.format_number(n, 0), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
