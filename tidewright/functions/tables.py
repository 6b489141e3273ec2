"""Functions from the rows of a partition to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf


@arrow_udtf(returnType="key string, value string, first long, last long, n long")
class Streaks:
    """Stretches of equal neighbouring values of one partition (key, value, place), in the order it comes in.

    Rows pass through in Arrow batches and only the open stretch is kept, so a partition may be of any size.
    """

    def __init__(self) -> None:
        self.open: tuple | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        key, value, place = rows.columns
        key, value = key.cast(pa.string()), value.cast(pa.string())
        out, places, last = [], place.to_pylist(), rows.num_rows - 1
        # Places in the batch at which the value differs from the one before, null being a value.
        changed = pc.or_kleene(pc.not_equal(value[1:], value[:-1]), pc.not_equal(pc.is_null(value[1:]), pc.is_null(value[:-1])))
        cuts = [0, *(i + 1 for i, c in enumerate(pc.fill_null(changed, False).to_pylist()) if c), last + 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k, v = key[a].as_py(), value[a].as_py()
            if self.open and self.open[:2] == (k, v):
                self.open = (k, v, self.open[2], places[b - 1], self.open[4] + b - a)
            else:
                if self.open:
                    out.append(self.open)
                self.open = (k, v, places[a], places[b - 1], b - a)
        if out:
            yield _table(out)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open:
            yield _table([self.open])


def _table(rows: list[tuple]) -> pa.Table:
    key, value, first, last, n = zip(*rows, strict=True)
    return pa.table([pa.array(key, pa.string()), pa.array(value, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(n, pa.int64())], names=["key", "value", "first", "last", "n"])


def streaks(df: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value, first, last, n) of the stretches of equal values of each key in the order of ``place``."""
    return Streaks(df.select(key, value, place).asTable().partitionBy(key).orderBy(place))
