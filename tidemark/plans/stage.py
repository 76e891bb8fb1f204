"""Tables written between the jobs of one query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the context's checkpoint folder, or in local mode, where all is one
    machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody uses, for drop_written() to delete."""
    _TABLES.append(f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}")
    return _TABLES[-1]


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write df and read it back, so that later uses see the same rows."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete what written() wrote; call it when results were stored. Gives the number of tables."""
    n = len(_TABLES)
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
