"""Reading the named tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
