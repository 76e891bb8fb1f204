"""What each vendor's API allows, as a table that queries join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page, ids of a batch, rows that a search reaches (null: it has none),
#: seconds that the deletes endpoint remembers (null: archived rows stay in scans), rows of a bulk job.
VENDORS = [("atlas", 200, 200, None, 7200.0, 100_000), ("beacon", 100, 100, 10_000, None, None)]
SCHEMA = "vendor string, page long, batch long, ceiling long, retention double, bulk long"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENDORS, SCHEMA)


def with_rules(rows: DataFrame) -> DataFrame:
    """rows for each vendor, with its rules beside them; a vendor that keeps archived rows has a
    null retention."""
    return rows.crossJoin(F.broadcast(rules(rows.sparkSession)))  # one row per vendor
