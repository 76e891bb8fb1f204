"""Results as JSON documents, one file each, and back as rows of a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.stage import written

BROKEN = "_broken"


def write(rows: DataFrame, name: str, path: str) -> None:
    """A document, keys in order and spread over lines, for each row; ``name`` tells them apart."""
    sorted_ = rows.select(name, F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"pretty": "true"}).alias("value"))
    sorted_.repartition(name).write.partitionBy(name).text(path)


def read(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of whole documents, (file, text) of those that aren't JSON of the schema)."""
    declared = StructType([*schema.fields]).add(BROKEN, "string")
    found = spark.read.schema(declared).option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).option("recursiveFileLookup", True).json(path)
    found = written(found.withColumn("file", F.input_file_name()), "results")  # parsed once; Spark can't query broken rows alone otherwise
    return found.where(F.col(BROKEN).isNull()).drop(BROKEN, "file"), found.where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("text"))
