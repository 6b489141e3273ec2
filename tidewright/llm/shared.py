"""Intermediate tables in the folder that driver and executors share, and a few plan helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Where none is set, a temporary one is made in local mode only: on a cluster no other machine would see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again.

    This cuts the lineage: an executor that is lost later costs no recomputation of what is
    written, since every executor sees the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewright/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shards_of(spark: SparkSession, per_partition: int = 2, size: int = 0, most: int = 1) -> int:
    """How many hash shards packed data is dealt into.

    It follows the session's shuffle partitions, and is so large that a shard of data of ``size`` holds ``most`` at most.
    """
    return max(4, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // most))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of a column of texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns called ``names`` in any case, so that results may carry these names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
