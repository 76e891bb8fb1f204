"""A vendor's read API as a Spark data source: scans by modification stamp over a published store.

publish() writes rows in ranges of (stamp, key), each a file with its bounds in a listing.
``spark.read.format("tidemark_vendor")`` takes bounds on the stamp and the key down to the ranges,
which are its input partitions; ``readStream`` gives what was modified after the last batch, and its
offset is the source's watermark: the highest stamp that was published when a batch began. Rows that
are published later with a lower stamp are never delivered, as with any such API.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

NAME = "tidemark_vendor"
#: Rows of a range and ranges of a publication, if its caller doesn't say.
LEAST, MOST = 4096, 10_000


def publish(rows: DataFrame, path: str, stamp: str = "last_modified", key: str = "id", per_range: int | None = None) -> None:
    """Append rows to the store at ``path`` in ranges of about per_range rows in order of (stamp, key);
    if null, of LEAST rows or so many more that there are MOST ranges.

    The listing of a publication is written after its ranges, so that a failed one isn't seen.
    """
    spark, name, n = rows.sparkSession, uuid.uuid4().hex, rows.count()
    if not n:
        return
    ranges = -(-n // (per_range or max(LEAST, n // MOST)))
    sorted_ = rows.repartitionByRange(ranges, stamp, key).sortWithinPartitions(stamp, key)
    sorted_.write.parquet(f"{path}/ranges/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/ranges/{name}")
    each = written.groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("n"), F.min(stamp).alias("low"), F.max(stamp).alias("high"), F.min(key).alias("low_key"), F.max(key).alias("high_key"))
    head = {"schema": rows.schema.jsonValue(), "stamp": stamp, "key": key}
    each.withColumn("head", F.lit(json.dumps(head))).coalesce(1).write.json(f"{path}/listings/{name}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.dataSource.register(VendorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Range(InputPartition):
    """A file of the store and the bounds that its rows must meet: (column, operator, value)."""

    file: str
    bounds: list[tuple[str, str, float]]


def _filesystem(uri: str):
    from pyarrow import fs

    if ":" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)


class Store:
    """The listing of a store: one entry per range."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        files, root = _filesystem(path)
        found = files.get_file_info(fs.FileSelector(f"{root}/listings", recursive=True, allow_not_found=True))
        done = {f.path.rsplit("/", 1)[0] for f in found if f.path.endswith("/_SUCCESS")}
        self.ranges = []
        for f in found:
            if f.path.endswith(".json") and f.path.rsplit("/", 1)[0] in done:
                with files.open_input_stream(f.path) as stream:
                    self.ranges += [json.loads(line) for line in stream.read().decode().splitlines()]
        self.head = json.loads(self.ranges[0]["head"]) if self.ranges else None

    def overlapping(self, bounds: list[tuple[str, str, float]]) -> list[Range]:
        """The ranges that may hold rows within the bounds."""
        out = []
        for r in sorted(self.ranges, key=lambda r: (r["low"], r["low_key"])):
            ends = {self.head["stamp"]: (r["low"], r["high"]), self.head["key"]: (r["low_key"], r["high_key"])}
            if all(_meets(op, *ends[column], value) for column, op, value in bounds):
                out.append(Range(r["file"], bounds))
        return out


def _meets(op: str, low, high, value) -> bool:
    """Whether some x in [low, high] may have x op value."""
    return {">=": high >= value, ">": high > value, "<=": low <= value, "<": low < value, "=": low <= value <= high}[op]


def _rows(part: Range) -> Iterator:
    """Arrow batches of a range; Parquet's own statistics prune row groups too."""
    import pyarrow.dataset as ds

    expression = None
    for column, op, value in part.bounds:
        field = ds.field(column)
        one = {">=": field >= value, ">": field > value, "<=": field <= value, "<": field < value, "=": field == value}[op]
        expression = one if expression is None else expression & one
    files, path = _filesystem(part.file)
    yield from ds.dataset(path, format="parquet", filesystem=files).to_batches(filter=expression)


class VendorSource(DataSource):
    """Options: path, the store's folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        head = Store(self.options["path"]).head
        if head is None:
            raise ValueError(f"nothing was published at {self.options['path']}; name a schema")
        return StructType.fromJson(head["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScanReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ModifiedReader(self.options["path"])


class ScanReader(DataSourceReader):
    OPERATORS = {GreaterThanOrEqual: ">=", GreaterThan: ">", LessThanOrEqual: "<=", LessThan: "<", EqualTo: "="}

    def __init__(self, path: str) -> None:
        self.path = path
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take bounds on the stamp and the key over; Spark keeps the others."""
        head = Store(self.path).head or {}
        for f in filters:
            if type(f) in self.OPERATORS and f.attribute in {(head.get("stamp"),), (head.get("key"),)}:
                self.bounds.append((f.attribute[0], self.OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return Store(self.path).overlapping(self.bounds)

    def read(self, partition: Range) -> Iterator:
        return _rows(partition) if partition is not None else iter(())


class ModifiedReader(DataSourceStreamReader):
    """Offsets are watermarks; a batch holds the stamps after one and up to the next."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"watermark": None}

    def latestOffset(self) -> dict:
        return {"watermark": max((r["high"] for r in Store(self.path).ranges), default=None)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store = Store(self.path)
        if end["watermark"] is None:
            return []
        bounds = [(store.head["stamp"], "<=", end["watermark"])]
        if start["watermark"] is not None:
            bounds.append((store.head["stamp"], ">", start["watermark"]))
        return store.overlapping(bounds)

    def read(self, partition: Range) -> Iterator:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the store keeps its ranges."""
