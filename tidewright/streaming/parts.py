"""A stream read as it grows: parts of a table arrive one after another, and each is read to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.sources.shared import new_path


def ended(query: StreamingQuery, seconds: float) -> None:
    """Waits for a query that ends by itself; after ``seconds`` it is stopped and an error raised."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} seconds")


def in_parts(parts: Iterable[DataFrame], read: Callable[[DataFrame], DataFrame], mode: str = "append", view: Callable[[DataFrame], DataFrame] | None = None, seconds: float = 1800) -> DataFrame:
    """What ``read`` (a streaming plan) delivers for a stream that gets ``parts`` one after another, with ``part`` from 0.

    Each part is written to the stream's folder, then the stream runs from its checkpoint until nothing is left
    and its watermark has taken effect, as a subscription does that is always on. ``view`` is applied to each
    delivery. Deliveries go to a folder for each part and batch, so one that is repeated after a failure
    replaces itself. All folders are in the shared one.
    """
    parts = list(parts)
    spark: SparkSession = parts[0].sparkSession
    source, results, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    shown: list = []
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(source)

        def deliver(rows: DataFrame, batch: int, n: int = n) -> None:
            rows = view(rows) if view else rows
            shown[:] = [rows.schema]
            rows.write.mode("overwrite").parquet(f"{results}/part={n}/batch={batch}")

        stream = read(spark.readStream.schema(parts[0].schema).parquet(source))
        ended(stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(deliver).trigger(availableNow=True).start(), seconds)
    if not shown:
        return spark.createDataFrame([], read(parts[0]).schema).withColumn("part", F.lit(0))
    return spark.read.schema(shown[0].add("part", "integer").add("batch", "long")).option("basePath", results).parquet(results)
