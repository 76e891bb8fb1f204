"""A table of the latest version of each key that is upserted without rewriting it.

Keys lie in buckets, each one's rows in a folder of their own. A merge reads and writes only the
buckets that its rows touch, into new folders, and then puts up a manifest that names every bucket's
folder; the manifest's rename is the only step that readers see. A merge that dies leaves folders
that no manifest names, and the version before stays whole. ``vacuum`` deletes such folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.draws import bucket


@dataclass
class Manifest:
    """One version: each bucket's folder, the rows' schema and the last batch that went in."""

    version: int = 0
    batch: int = -1
    buckets: int = 0
    schema: dict = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The version asked for, the last one if none is; an empty table before the first merge."""
    there = versions(spark, path)
    if not there:
        return Manifest()
    row = spark.read.text(f"{path}/manifests/{there[-1] if version is None else version}.json", wholetext=True).first()
    return Manifest(**json.loads(row[0]))


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Put a manifest up whole, or fail if another writer has put this version up."""
    files, draft = _files(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    _, to = _files(spark, f"{path}/manifests/{new.version}.json")
    if files.exists(to) or not files.rename(draft, to):
        files.delete(draft, False)
        raise RuntimeError(f"version {new.version} of {path} is another writer's")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is in a version."""
    now = manifest(spark, path, version)
    if not now.folders:
        raise ValueError(f"nothing was merged into {path}")
    return spark.read.schema(StructType.fromJson(now.schema)).parquet(*now.folders.values())


def merge(rows: DataFrame, path: str, key: str, version: str, buckets: int = 64, batch: int | None = None) -> Manifest:
    """Upsert rows: the highest version of a key stays, an equal one overwrites. A batch that went
    in before changes nothing. The number of buckets is fixed by the first merge; a merge lists the
    touched ones on the driver, that many numbers at most."""
    spark, was = rows.sparkSession, manifest(rows.sparkSession, path)
    if batch is not None and batch <= was.batch:
        return was
    n = was.buckets or buckets
    columns = rows.columns
    new = rows.withColumn("__bucket", bucket("store", key, n))
    touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())
    both = new.withColumn("__new", F.lit(True))
    held = [was.folders[str(b)] for b in touched if str(b) in was.folders]
    if held:
        old = spark.read.schema(rows.schema).parquet(*held).withColumn("__bucket", bucket("store", key, n)).withColumn("__new", F.lit(False))
        both = both.unionByName(old)
    last = both.groupBy("__bucket", key).agg(F.max_by(F.struct(*columns), F.struct(version, "__new")).alias("__row")).select("__row.*", "__bucket")
    folder = f"{path}/data/{uuid.uuid4().hex}"
    last.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    folders = was.folders | {str(b): f"{folder}/__bucket={b}" for b in touched}
    now = Manifest(was.version + 1, was.batch if batch is None else batch, n, rows.schema.jsonValue(), folders)
    _commit(spark, path, now)
    return now


def upsert(stream: DataFrame, path: str, key: str, version: str, checkpoint: str, buckets: int = 64) -> None:
    """Merge a stream's batches as they come, each once, until nothing is left."""
    q = (
        stream.writeStream.foreachBatch(lambda rows, n: merge(rows, path, key, version, buckets, n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete manifests but the last ``keep`` and the folders that none of them names. No merge may
    run meanwhile. Gives the number of folders deleted."""
    there = versions(spark, path)
    for old in there[:-keep]:
        files, at = _files(spark, f"{path}/manifests/{old}.json")
        files.delete(at, False)
    named = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] + "/" + f.rsplit("/", 1)[1] for v in there[-keep:] for f in manifest(spark, path, v).folders.values()}
    files, data = _files(spark, f"{path}/data")
    gone = 0
    for batch in files.listStatus(data) if files.exists(data) else []:
        for part in files.listStatus(batch.getPath()):
            if part.isDirectory() and f"{batch.getPath().getName()}/{part.getPath().getName()}" not in named:
                files.delete(part.getPath(), True)
                gone += 1
    return gone
