"""Joins of points and spans on an axis of whole numbers, such as microseconds.

The axis is cut into bins of several widths, each twice the one before. A span stands in the bins of the
narrowest width that is not below its length, so it touches two at most, however long it is; a point stands
in one bin of each width that occurs. So the join is by equality of bins, which Spark shuffles and, where a
bin is hot, splits; what meets is checked exactly, and each pair meets once.

Where only totals of what overlaps are asked for, no pair is made: the axis is cut where spans begin and end, into bins
of about as many ends each, and a bin's spans are summed in order of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of spans in a bin, about.
PER_BIN = 1 << 16
_NONE = np.iinfo(np.int64).max


def _width(start: Column, end: Column) -> Column:
    """Bits of the narrowest width of bins that a span [start, end) fits."""
    return F.length(F.conv((end - start - 1).cast("string"), 10, 2)).cast("int") * F.when(end - start > 1, 1).otherwise(0)


def _bin(at: Column, width: Column) -> Column:
    return F.call_function("shiftright", at, width)


def _spans(df: DataFrame, start: str, end: str, on: list[str]) -> DataFrame:
    """(width, first bin, last bin, on, row) of spans that hold something."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    held = df.where(s < e).select(_width(s, e).alias("w"), s.alias("s"), e.alias("e"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return held


def _widths(spans: DataFrame) -> list[int]:
    """The widths that occur; at most 64."""
    return sorted(r[0] for r in spans.select("w").distinct().collect())


def _levels(widths: list[int]) -> Column:
    return F.array(*[F.lit(w) for w in widths]) if widths else F.array().cast("array<int>")


def points_in_spans(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, on: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(point, span), structs of rows with start <= at < end and equal columns ``on`` (of points, of spans).

    Empty spans, nulls on the axis and null keys meet nothing; repeated rows meet each for itself.
    """
    held = _spans(spans, start, end, [b for _, b in on])
    keys = [f"k{i}" for i in range(len(on))]
    widths = _widths(held)
    marks = points.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("t"), *[F.col(a).alias(k) for k, (a, _) in zip(keys, on, strict=True)], F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"))
    marks = marks.withColumn("w", F.explode(_levels(widths))).withColumn("b", _bin(F.col("t"), F.col("w")))
    bins = F.array_distinct(F.array(_bin(F.col("s"), F.col("w")), _bin(F.col("e") - 1, F.col("w"))))
    placed = held.withColumn("b", F.explode(bins)).withColumnRenamed("row", "span")
    return marks.join(placed, ["w", "b", *keys]).where("s <= t and t < e").select("point", "span")


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(left, right), structs of rows whose spans [start, end) share a place, with equal columns ``on``.

    Two spans meet in bins of the longer one's width, and count in the one in which the later of them starts.
    """
    l, r = _spans(left, start, end, list(on)), _spans(right, start, end, list(on))
    keys = [f"k{i}" for i in range(len(on))]
    widths = sorted({*_widths(l), *_widths(r)})

    def placed(x: DataFrame, side: str) -> DataFrame:
        x = x.withColumn("v", F.explode(F.filter(_levels(widths), lambda v: v >= F.col("w"))))
        bins = F.array_distinct(F.array(_bin(F.col("s"), F.col("v")), _bin(F.col("e") - 1, F.col("v"))))
        return x.withColumn("b", F.explode(bins)).select("v", "b", *keys, *[F.col(c).alias(f"{side}{c}") for c in ("w", "s", "e", "row")])

    met = placed(l, "l").join(placed(r, "r"), ["v", "b", *keys])
    once = (F.col("v") == F.greatest("lw", "rw")) & (F.col("b") == _bin(F.greatest("ls", "rs"), F.col("v")))
    return met.where(once & (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le"))).select(F.col("lrow").alias("left"), F.col("rrow").alias("right"))


def overlap_totals(left: DataFrame, right: DataFrame, start: str, end: str, key: str, value: str) -> DataFrame:
    """(key, n, least, shared) for each ``key`` of ``left`` of which a span [start, end) overlaps spans of ``right``: how
    many do, their least ``value`` (whole numbers), and the places shared with all of them.

    Equal to sums over ``overlapping``, but work follows the rows, not the pairs. A span of ``right`` stands in the bins of its
    two ends only; those between, which it fills, have a count and a least value. Ends of one place are in one bin.
    """
    spans = right.select(F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"), F.col(value).cast("long").alias("v")).where("a < b")
    asked = left.select(F.col(key).alias("key"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).where("a < b")
    bins = -(-2 * spans.count() // PER_BIN)
    ends = spans.select(F.explode(F.array("a", "b")).alias("at"))
    cuts = np.unique(np.array(ends.approxQuantile("at", [k / bins for k in range(1, bins)], 1 / (8 * bins)) if bins > 1 else [], np.int64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (np.searchsorted(cuts, batch.column(c).to_numpy() - d, "right") for c, d in (("a", 0), ("b", 1)))
            yield pa.record_batch([*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*batch.schema.names, "first", "last"])

    def dealt(rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(placed, f"{kinds}, first int, last int")

    spans, asked = dealt(spans), dealt(asked)
    filled = spans.where("last - first > 1").groupBy("first", "last").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    filled = filled.withColumn("bin", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1))).groupBy("bin").agg(F.sum("n").alias("full"), F.min("v").alias("full_least"))
    asked = asked.withColumn("bin", F.explode(F.sequence("first", "last"))).join(filled, "bin", "left")
    asked = asked.select("bin", "key", "a", "b", (F.col("bin") == F.col("first")).alias("opens"), F.coalesce("full", F.lit(0)).alias("full"), "full_least")
    spans = spans.withColumn("bin", F.explode(F.array_distinct(F.array("first", "last")))).select("bin", "a", "b", "v")
    kind = asked.schema["key"].dataType.simpleString()
    found = asked.groupBy("bin").cogroup(spans.groupBy("bin")).applyInArrow(lambda x, y: _totals(x, y, cuts), f"key {kind}, n long, least long, shared long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("shared").alias("shared")).where("n > 0").withColumnRenamed("key", key)


def _totals(asked: pa.Table, spans: pa.Table, cuts: np.ndarray) -> pa.Table:
    """Of one bin's part of each row of ``asked``: spans met here first, the least value of all met, and places shared."""
    column = lambda t, c, none=0: t.column(c).fill_null(none).to_numpy()
    if not len(asked):
        return pa.table({"key": asked.column("key"), "n": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
    at = int(asked.column("bin")[0].as_py())
    low, high = cuts[at - 1] if at else -_NONE, cuts[at] if at < len(cuts) else _NONE
    x, y = np.maximum(column(asked, "a"), low), np.minimum(column(asked, "b"), high)
    n, least, full = column(asked, "full"), column(asked, "full_least", _NONE), column(asked, "full")
    shared, opens = full * (y - x), column(asked, "opens", False)
    n = np.where(opens, n, 0)  # what fills a later bin has been met before
    if len(spans):
        a, s, e = column(spans, "a"), np.maximum(column(spans, "a"), low), np.minimum(column(spans, "b"), high)
        begun, starts, stops = np.sort(a[a >= low]), np.sort(s), np.sort(e)
        here = np.searchsorted(starts, y) - np.searchsorted(stops, x, "right")
        n = n + np.where(opens, here, np.searchsorted(begun, y))
        shared = shared + _covered(starts, stops, y) - _covered(starts, stops, x)
        least = np.minimum(least, _least(s, e, column(spans, "v", _NONE), x, y))
    return pa.table({"key": asked.column("key"), "n": n, "least": pa.array(least, mask=least == _NONE), "shared": shared})


def _covered(starts: np.ndarray, stops: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Places before ``to`` of all spans, by their ordered ends."""
    base, out = starts[0], np.zeros(len(to), np.int64)
    for ends, sign in ((starts, 1), (stops, -1)):
        sums, k = np.append(0, np.cumsum(ends - base)), np.searchsorted(ends, to)
        out += sign * (k * (to - base) - sums[k])
    return out


def _least(s: np.ndarray, e: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least value of the spans [s, e) that overlap each [x, y), by minima over runs of powers of two of the places between ends."""
    ends = np.unique(np.concatenate([s, e]))
    i, j = np.searchsorted(ends, s), np.searchsorted(ends, e)
    most = int(np.log2(len(ends)))
    runs = np.full((most + 1, len(ends)), _NONE, np.int64)
    level = np.frexp(j - i)[1] - 1
    np.minimum.at(runs, (level, i), v)
    np.minimum.at(runs, (level, j - (1 << level)), v)
    for k in range(most, 0, -1):  # to each place the least of all runs over it
        half = 1 << (k - 1)
        runs[k - 1] = np.minimum(runs[k - 1], runs[k])
        runs[k - 1, half:] = np.minimum(runs[k - 1, half:], runs[k, :-half])
    for k in range(1, most + 1):  # and to each run the least of its places
        half = 1 << (k - 1)
        runs[k] = runs[k - 1]
        runs[k, :-half] = np.minimum(runs[k - 1, :-half], runs[k - 1, half:])
    p, q = np.maximum(np.searchsorted(ends, x, "right") - 1, 0), np.searchsorted(ends, y)
    some = q > p
    level = np.frexp(np.where(some, q - p, 1))[1] - 1
    return np.where(some, np.minimum(runs[level, p], runs[level, np.maximum(q - (1 << level), 0)]), _NONE)
