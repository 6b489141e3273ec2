"""Live collections: the whole ordered result again after every change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.sources.shared import new_path
from tidewright.streaming.parts import ended, in_parts

CHANGES = ("seq", "op")


def latest(changes: DataFrame, key: str = "id") -> DataFrame:
    """The rows that a changelog (seq, op, key and fields) leaves: the last of each key, unless it deletes.

    The same plan serves a table and a stream; on a stream it keeps one row of state a key.
    """
    fields = [c for c in changes.columns if c not in CHANGES]
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("op", *fields), "seq").alias("_last"))
    return last.where("_last.op <> 'delete'").select(*[F.col(f"_last.{c}").alias(c) for c in fields])


def subscribe(changes: DataFrame, deliver: Callable[[DataFrame], None], view: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "id", **trigger) -> StreamingQuery:
    """Calls ``deliver`` with ``view`` (a filter and an order) of the full result after each batch of changes.

    Complete mode hands over all keys each time, which suits collections, not event streams.
    ``stop()`` of the query that is returned ends the subscription.
    """
    return (
        latest(changes, key)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, _: deliver(view(rows)))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_to_end(changes: DataFrame, view: Callable[[DataFrame], DataFrame], key: str = "id", seconds: float = 1800) -> DataFrame:
    """What the last delivery of a subscription to ``changes`` shows, once all that is there has been read.

    Deliveries and the stream's checkpoint are in the folder that spark.checkpoint.dir names, which all executors see.
    """
    folder, shown = new_path(changes.sparkSession, "live"), []

    def deliver(rows: DataFrame) -> None:
        path = f"{folder}/delivered-{len(shown)}"
        rows.write.parquet(path)
        shown.append((path, rows.schema))

    ended(subscribe(changes, deliver, view, f"{folder}/checkpoint", key), seconds)
    if not shown:
        return view(changes.sparkSession.createDataFrame([], latest(changes, key).schema))
    path, schema = shown[-1]
    return changes.sparkSession.read.schema(schema).parquet(path)


def deliveries(parts: list[DataFrame], view: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Every delivery of a subscription to changes that come in ``parts``: ``view`` of the full result, with ``part``."""
    return in_parts(parts, lambda changes: latest(changes, key), "complete", view).drop("batch")
