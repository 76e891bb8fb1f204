"""Keyed state over streams: failure runs that disable a subscription, first arrivals with expiry.

State lives in RocksDB, one value per subscription or bucket of events; first arrivals are forgotten
by event-time timers.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own setting comes back."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


class FailureRuns(StatefulProcessor):
    """Rows (seq, down) of a subscription, in order of seq, to (key, seq, run, disabled): failures in
    a row so far; after ``limit`` of them the subscription is disabled, and its run stays. A batch's
    rows of one subscription are put in order in memory: maxFilesPerTrigger bounds them."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(rows).sort_values("seq")
        run = self.run.get()[0] if self.run.exists() else 0
        runs = []
        for down in found["down"].tolist():
            run = self.limit if run >= self.limit else run + 1 if down else 0
            runs.append(run)
        self.run.update((run,))
        yield pd.DataFrame({"subscription": key[0], "seq": found["seq"].to_numpy(), "run": runs, "disabled": [r >= self.limit for r in runs]})

    def close(self) -> None:
        """Nothing is held outside the state."""


class FirstArrivals(StatefulProcessor):
    """Rows of a bucket of events' deliveries to each event's first one, by arrival; a timer forgets
    an event once the watermark is ``keep_ms`` past it.

    A bucket's events lie in one value, as Arrow's columns of keys and times, so that a batch costs a
    few calls a bucket and not a few an event. One timer a bucket waits for its oldest event.
    """

    def __init__(self, keep_ms: int, columns: list[str], key: str, at: str) -> None:
        self.keep_ms, self.columns, self.key, self.at = keep_ms, columns, key, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "held binary")

    def _held(self) -> pa.Table | None:
        return pa.ipc.open_stream(self.seen.get()[0]).read_all() if self.seen.exists() else None

    def _hold(self, held: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        self.seen.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values(self.at, kind="stable").drop_duplicates(self.key)
        held = self._held()
        oldest = None
        if held is not None:
            new, oldest = new[~new[self.key].isin(held["key"].to_pandas())], pc.min(held["at"]).as_py()
        if not len(new):
            return
        at = [int(t.timestamp() * 1000) for t in new[self.at]]
        more = pa.table({"key": pa.array(new[self.key], from_pandas=True), "at": pa.array(at, pa.int64())})
        self._hold(more if held is None else pa.concat_tables([held, more], promote_options="permissive"))
        if oldest is None or min(at) < oldest:
            if oldest is not None:
                self.handle.deleteTimer(oldest + self.keep_ms)
            self.handle.registerTimer(min(at) + self.keep_ms)
        yield new[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1) - self.keep_ms
        held = self._held()
        left = held.filter(pc.greater(held["at"], past))
        if left.num_rows:
            self._hold(left)
            self.handle.registerTimer(pc.min(left["at"]).as_py() + self.keep_ms)
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state."""


def failure_runs(stream: DataFrame, limit: int) -> DataFrame:
    """(subscription, seq, run, disabled) for a stream (subscription, seq, down) whose batches come
    in order of seq."""
    kind = f"subscription {stream.schema['subscription'].dataType.simpleString()}, seq long, run long, disabled boolean"
    return stream.select("subscription", "seq", "down").groupBy("subscription").transformWithStateInPandas(FailureRuns(limit), kind, "Append", "None")


def first_arrivals(stream: DataFrame, key: str, at: str, lateness: str, keep_ms: int, buckets: int = 1024) -> DataFrame:
    """The first row of each key; a key that comes again once it was forgotten is a new one. A bucket's
    rows of a batch and the keys that it remembers are held in memory: maxFilesPerTrigger bounds the
    first, ``buckets``, which a checkpoint fixes, both."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    dealt = stream.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withWatermark(at, lateness)
    return dealt.groupBy("__bucket").transformWithStateInPandas(FirstArrivals(keep_ms, stream.columns, key, at), kind, "Append", "EventTime")
