"""Files as tables: corpora kept as JSON, one folder a version, feeds kept as XML text, key-value settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import settings

BOOKS = "abbrev string, name string, chapters array<array<string>>"


def corpus(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """(version, abbrev, name, chapters) of ``folder/version=…/*.json``, each file an array of books.

    A version is a partition, so that asking for one reads its files only.
    """
    books = spark.read.schema(BOOKS).option("multiLine", True).option("basePath", folder).json(f"{folder}/version=*")
    return books.where(F.col("version") == version) if version else books


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): each file is one feed."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def stored_settings(spark: SparkSession, path: str) -> DataFrame:
    """(settings) of each line of JSON text, with defaults."""
    return spark.read.text(path).select(settings(F.col("value")).alias("settings"))
