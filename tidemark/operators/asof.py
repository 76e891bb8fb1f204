"""What held at arbitrary instants: an interval join by cells of a tree over time.

An interval is cut into the fewest cells of a tree of FANOUT-fold cells that cover it, an instant
lies in one cell of each level. Both meet in an equi-join on (key, level, cell), so that a hot key's
rows are spread over its cells and no task goes through a key's whole history. Keys of few versions
need no cells: they meet by key, and each row goes through one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stage import written

FANOUT = 8
#: Up to this many versions of a key are all compared with its instants.
FEW = 64


def _cells(first: Column, last: Column, levels: int) -> Column:
    """The (level, cell) pairs that cover leaf cells first..last and no others."""
    pieces, a, b = [], first, last
    span = lambda level, x, y: F.transform(
        F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>")), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))
    for level in range(levels - 1):
        up, down = F.ceil(a / FANOUT).cast("long"), (F.floor((b + 1) / FANOUT) - 1).cast("long")  # cells one level up that lie within
        left_end = F.least(b, up * FANOUT - 1)
        pieces += [span(level, a, left_end), span(level, F.greatest(left_end + 1, (down + 1) * FANOUT), b)]
        a, b = up, down
    pieces.append(span(levels - 1, a, b))
    return F.concat(*pieces)


def join(instants: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str, leaf: float, levels: int) -> DataFrame:
    """instants with the columns of the versions of their key that hold at that time, start <= at <
    end, a null end being open; instants without one are left out.

    Only keys of more than FEW versions go by cells. Leaf cells are ``leaf`` long; times reach from 0,
    or before it where they count as the first cell's, to leaf * FANOUT ** (levels - 1) and beyond,
    where they count as the last one's.
    """
    hot = written(versions.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(key), "hot")
    holds = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    cold = instants.join(hot, key, "left_anti").join(versions.join(hot, key, "left_anti"), key).where(holds)
    instants, versions = instants.join(hot, key, "left_semi"), versions.join(hot, key, "left_semi")
    top = FANOUT ** (levels - 1) - 1
    cell = lambda t: F.greatest(F.lit(0), F.least(F.lit(top), F.floor(t / leaf))).cast("long")
    held = versions.withColumn("__x", F.explode(_cells(cell(F.col(start)), F.coalesce(cell(F.col(end)), F.lit(top).cast("long")), levels)))
    held = held.select(*(F.col(c) for c in versions.columns), F.col("__x.level").alias("__level"), F.col("__x.cell").alias("__cell"))
    asked = instants.withColumn("__leaf", cell(F.col(at))).withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    asked = asked.withColumn("__cell", F.floor(F.col("__leaf") / F.pow(F.lit(float(FANOUT)), F.col("__level"))).cast("long")).drop("__leaf")
    both = asked.join(held, [key, "__level", "__cell"])
    return cold.unionByName(both.where(holds).drop("__level", "__cell"))
