"""Tables that are only appended to, and results as JSON or markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Change logs and audit rows, added to what is there."""
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON object on each line, keys in the order of the columns."""
    rows.write.mode("append").json(path)


def reports(rows: DataFrame, path: str, key: str, md: str) -> None:
    """Markdown reports, one directory for each key, each text in one file of its own row."""
    rows.select(key, F.col(md).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
