"""A lossy at-least-once event channel: deliveries, dedup, disabling, detection latency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw


def lag() -> Column:
    """How long a delivery takes, from 2 to 10 seconds."""
    return 2.0 + (draw("wd", "seq") % 8000) / F.lit(1000.0)


def deliveries(changes: DataFrame, loss: int = 3, duplicate: int = 5, reorder: int = 4) -> DataFrame:
    """(arrival, event_id, record_id, event_at, seq, copy): percentages of the changes are lost,
    sent twice (a second later) or held back by 30 seconds; all take 2 to 10 seconds."""
    delay = lag()
    late = F.when(draw("wr", "seq") % 100 < reorder, 30.0).otherwise(0.0)
    copies = F.when(draw("w2", "seq") % 100 < duplicate, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = changes.where(draw("wl", "seq") % 100 >= loss)
    return sent.select((F.col("event_at") + delay + late).alias("first"), "seq", "record_id", "event_at", F.explode(copies).alias("copy")).select(
        (F.col("first") + F.col("copy")).alias("arrival"), F.concat_ws("-", F.lit("evt"), F.col("seq").cast("string")).alias("event_id"), "record_id", "event_at", "seq", "copy")


def first_seen(events: DataFrame) -> DataFrame:
    """Each event_id's earliest delivery."""
    return events.groupBy("event_id").agg(F.min(F.struct("arrival", "copy", "record_id", "event_at", "seq")).alias("x")).select("event_id", "x.*")


def failure_runs(changes: DataFrame, down_from: float, down_until: float, span: int | None = None) -> DataFrame:
    """(seq, down, run): how many deliveries in a row have failed, in order of the log.

    Gaps and islands within ranges of ``span`` numbers; a run that reaches a range's end is carried
    into the next one, over one row per range. Ranges grow with the root of the log's length, so
    that neither they nor their number are more than a task holds.
    """
    if span is None:
        span = max(4096, math.isqrt(changes.agg(F.max("seq")).first()[0] or 0))
    arrival = F.col("event_at") + lag()
    marked = changes.select(
        "seq", F.floor(F.col("seq") / span).alias("range"), arrival.between(down_from, down_until).cast("int").alias("down"), arrival.alias("arrival"))
    ups = F.sum(1 - F.col("down")).over(Window.partitionBy("range").orderBy("seq"))
    run = F.sum("down").over(Window.partitionBy("range", "ups").orderBy("seq"))
    local = marked.withColumn("ups", ups).withColumn("run", run)
    ends = local.groupBy("range").agg(F.max_by("run", "seq").alias("tail"), F.max("ups").alias("ups"))
    order = Window.orderBy("range")
    ends = ends.withColumn("stretch", F.sum(F.when(F.col("ups") > 0, 1).otherwise(0)).over(order))
    ends = ends.withColumn("open", F.sum("tail").over(Window.partitionBy("stretch").orderBy("range")))
    carried = ends.select("range", F.coalesce(F.lag("open").over(order), F.lit(0)).alias("carried"))
    whole = F.col("run") + F.when((F.col("down") == 1) & (F.col("ups") == 0), F.col("carried")).otherwise(0)
    return local.join(carried, "range").select("seq", "arrival", (F.col("down") == 1).alias("down"), whole.alias("run"))
