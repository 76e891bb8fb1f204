"""Rate limits over logs of calls: when waiting callers get through, and how full windows are.

Waiting rules are closed forms over a running maximum, one window per caller, so that a log of any
length needs one shuffle by caller and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(calls: DataFrame, caller: str, at: str, order: str) -> tuple[DataFrame, Column]:
    """calls with call_no from 1 for each caller; and the window of those so far."""
    w = Window.partitionBy(caller).orderBy(at, order)
    return calls.withColumn("call_no", F.row_number().over(w).cast("long")), w.rowsBetween(Window.unboundedPreceding, 0)


def fixed_sleep(calls: DataFrame, caller: str, at: str, order: str, gap: float) -> DataFrame:
    """calls with start: a caller's calls keep ``gap`` seconds between them.

    start(i) = max over j <= i of at(j) + (i - j) * gap.
    """
    numbered, so_far = _numbered(calls, caller, at, order)
    shift = F.col("call_no") * F.lit(gap)
    return numbered.withColumn("start", F.greatest(F.col(at), F.max(F.col(at) - shift).over(so_far) + shift))


def token_bucket(calls: DataFrame, caller: str, at: str, order: str, rate: float, capacity: int) -> DataFrame:
    """calls with start: each takes a token of a caller's bucket, which holds ``capacity`` and fills
    at ``rate`` a second, and waits for one.

    The bucket is empty until full(i) = max over j <= i of at(j) + (i - j + 1) / rate; a call starts
    at its arrival or (capacity - 1) / rate before the bucket of the calls before it is full.
    """
    numbered, so_far = _numbered(calls, caller, at, order)
    shift = F.col("call_no") / F.lit(rate)
    full = F.max(F.col(at) - shift).over(so_far.rowsBetween(Window.unboundedPreceding, -1)) + shift
    return numbered.withColumn("start", F.greatest(F.col(at), full - F.lit((capacity - 1) / rate)))


def window_load(calls: DataFrame, caller: str, at: str, order: str, seconds: int, limit: int) -> DataFrame:
    """calls with in_window, a caller's calls in the ``seconds`` up to this one, it included, and
    over: whether they are more than ``limit``."""
    micros = F.round(F.col(at) * 1_000_000).cast("long")
    load = F.expr(f"count(*) over (partition by {caller} order by __micros range between {seconds * 1_000_000 - 1} preceding and current row)")
    out = calls.withColumn("__micros", micros).withColumn("in_window", load).drop("__micros")
    return out.withColumn("over", F.col("in_window") > limit)
