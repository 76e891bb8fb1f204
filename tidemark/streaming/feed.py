"""Streams fed in parts: a part is written, the query starts from its checkpoint, drains it and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.stage import new_path


def fed(spark: SparkSession, build: Callable[..., DataFrame], *parts: list[DataFrame]) -> tuple[DataFrame, list]:
    """What ``build`` makes of streams, one for each list of parts, and the progress of its batches.

    The lists are of one length; the k-th parts of all of them are there when the query starts for
    the k-th time. State has as many partitions as the session runs tasks at once, or fewer if the
    session's shuffles have: each is a task of every batch.
    """
    folders = [new_path(spark, "feed") for _ in parts]
    state, sink = new_path(spark, "state"), new_path(spark, "sink")
    out, progress = None, []
    for rows in zip(*parts, strict=True):
        for part, folder in zip(rows, folders, strict=True):
            part.write.mode("append").parquet(folder)
        if out is None:
            out = build(*(spark.readStream.schema(p[0].schema).parquet(f) for p, f in zip(parts, folders, strict=True)))
        shuffles = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", min(int(shuffles), spark.sparkContext.defaultParallelism))
        try:
            q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        q.awaitTermination()
        progress += q.recentProgress
    return spark.read.schema(out.schema).parquet(sink), progress
