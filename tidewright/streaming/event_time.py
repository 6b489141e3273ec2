"""Event-time windows, sessions and deduplication of streams, and the same rules for tables.

State is bounded: what ends before the watermark, the latest time seen less the delay that is allowed for,
is handed over and forgotten, and rows that could only change what is forgotten are turned down. The batch
forms state these rules over a table whose column ``part`` says in which part of the stream a row came.
Rows without time are in no window, no session and, as duplicates, turned down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(stream: DataFrame, at: str, delay: str, length: str, keys: list[str], *sums: Column, slide: str | None = None) -> DataFrame:
    """Sums by ``keys`` and window of event time, each window once, when the watermark passes its end.

    Without ``slide`` windows follow one another; with it, they overlap and a row is in each that holds it.
    """
    cols = [F.window(at, length, slide), *keys]
    return stream.withWatermark(at, delay).groupBy(*cols).agg(*sums)


def user_sessions(stream: DataFrame, at: str, delay: str, gap: str, keys: list[str], *sums: Column) -> DataFrame:
    """Sums by ``keys`` and session, each session once, when the watermark passes its last time plus the gap.

    A late row that falls between two sessions joins them in the state.
    """
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(*sums)


def distinct_rows(stream: DataFrame, at: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each ``keys``; a key is remembered until the watermark passes its first row's time plus the delay."""
    return stream.where(F.col(at).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def watermarks(rows: DataFrame, at: str, delay: str, part: str = "part") -> DataFrame:
    """(part, watermark) that holds when a part begins: the latest time of the parts before it, less ``delay``.

    Null for the first part. There is a row for each part of the stream, few enough for the driver.
    """
    found = sorted(rows.groupBy(part).agg(F.max(at)).collect())
    out, latest = [], None
    for p, most in found:
        out.append((p, latest))
        latest = max(x for x in (latest, most) if x is not None) if (latest or most) else None
    kind, spark = rows.schema[at].dataType.simpleString(), rows.sparkSession
    marks = spark.createDataFrame(out, f"`{part}` {rows.schema[part].dataType.simpleString()}, watermark {kind}")
    return F.broadcast(marks.withColumn("watermark", F.col("watermark") - F.expr(f"interval '{delay}'")))


def in_time(rows: DataFrame, at: str, delay: str, until: Column, part: str = "part") -> DataFrame:
    """Rows of a stream's parts that are not too late: ``until``, when their state ends, is after the watermark."""
    marked = rows.join(watermarks(rows, at, delay, part), part)
    return marked.where(until.isNotNull() & (F.col("watermark").isNull() | (until > F.col("watermark")))).drop("watermark")


def windows_of_parts(rows: DataFrame, at: str, delay: str, length: str, keys: list[str], *sums: Column, slide: str | None = None, part: str = "part") -> DataFrame:
    """What ``windows`` has handed over once all parts of ``rows`` have been read, as a plan over a table."""
    last = rows.agg(F.max(at).alias("last"))  # one row
    spread = rows.where(F.col(at).isNotNull()).withColumn("window", F.window(at, length, slide))
    marks = watermarks(rows, at, delay, part)
    end = F.col("window.end")
    kept = spread.join(marks, part).where(F.col("watermark").isNull() | (end > F.col("watermark")))
    whole = kept.groupBy("window", *keys).agg(*sums)
    return whole.join(F.broadcast(last), end <= F.col("last") - F.expr(f"interval '{delay}'")).drop("last")
