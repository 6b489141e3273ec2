"""Operations over a global order without one task for all rows: ranks, pages, as-of joins, sessions.

Rows are dealt into ranges of the order, sorted within each, and written once with the number of their
range and their place in it. What a range needs to know of those before it is a row for each range (and
group in it): counts, or the last value. So no window, group or task holds more than a range, and a group
that holds a third of all rows is cut into ranges like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.shared import written

_PLACES = (1 << 33) - 1


def free(name: str, *taken: list[str]) -> str:
    """``name``, longer by underscores while a column of any list has it in any case."""
    used = {c.lower() for cs in taken for c in cs}
    while name.lower() in used:
        name += "_"
    return name


def _cols(names) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def laid_out(df: DataFrame, *order: Column, within: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """``df`` written in the order of ``within`` and ``order``, and the names of its range and place columns.

    There are as many ranges as spark.sql.shuffle.partitions says. Rows equal in the order are told apart by a
    hash of all their columns, so a place is the same again for all but identical rows.
    """
    part, row = free("_part", df.columns), free("_row", df.columns)
    ties = [F.xxhash64(*_cols(f.name for f in df.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))]
    keys = [*_cols(within), *order, *ties]
    ranges = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    numbered = ranges.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)).alias(row))
    return written(numbered, "ordered"), part, row


def _offsets(rows: DataFrame, part: str) -> DataFrame:
    """(part, rows before it), a row for each range; the driver adds up one number a range."""
    counts = sorted(rows.groupBy(part).count().collect())
    before, out = 0, []
    for p, n in counts:
        out.append((p, before))
        before += n
    return F.broadcast(rows.sparkSession.createDataFrame(out, f"`{part}` int, _before long"))


def ranked(df: DataFrame, *order: Column, within: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """``df`` with ``name``, the place of each row in the order from 1, in all or within groups.

    Defined results: nulls sort as Spark sorts them (first ascending, last descending), and form a group of
    their own; of rows equal in the order each has its own place; an empty table gives an empty table.
    """
    rows, part, row = laid_out(df, *order, within=within)
    place = (F.col("_before") + F.col(row) + 1).alias(name)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    placed = rows.join(_offsets(rows.select(part), part), part)
    if not within:
        return placed.select(*kept, place)
    # A group's rows are next to each other in the whole order: a place within it counts from its first.
    heads = placed.groupBy(part, *within).agg(F.min(F.col("_before") + F.col(row)).alias("_first"))
    first = heads.groupBy(*within).agg(F.min("_first").alias("_first"))
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in within]
    heads = heads.drop("_first").alias("l").join(first.alias("r"), _all(same)).select(F.col(f"l.{part}"), *[F.col(f"l.`{c}`") for c in within], "r._first")
    met = placed.alias("l").join(heads.alias("r"), _all([F.col(f"l.{part}") == F.col(f"r.{part}"), *same]))
    return met.select(*[F.col(f"l.`{c}`") for c in df.columns if c != name], (F.col("l._before") + F.col(f"l.{row}") - F.col("r._first") + 1).alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def page_index(rows: DataFrame, keys: list[str], size: int, pos: str = "pos") -> DataFrame:
    """(page, rows, first, last) of ranked rows: the cursors (struct of ``keys``) that open and end each page."""
    page = F.expr(f"(`{pos}` - 1) div {int(size)}").alias("page")
    key = F.struct(*keys)
    return rows.groupBy(page).agg(F.count("*").alias("rows"), F.min_by(key, pos).alias("first"), F.max_by(key, pos).alias("last"))


def _beyond(key: str, value, descending: bool) -> Column:
    """Whether a row's key comes strictly after ``value`` in Spark's order of nulls."""
    c = F.col(f"`{key}`")
    if value is None:
        return F.lit(False) if descending else c.isNotNull()
    return ((c < value) | c.isNull()) if descending else (c > value)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], cursor: dict | None, size: int) -> DataFrame:
    """The ``size`` rows after ``cursor`` in the order of ``keys`` (name, descending); from the start without one.

    The cursor is the keys of the last row seen, so a page costs one filtered scan and the best rows of each
    task, whatever its number, and rows added before it move nothing. The keys must tell all rows apart.
    """
    if cursor is not None:
        later, equal = F.lit(False), F.lit(True)
        for key, descending in keys:
            later = later | (equal & _beyond(key, cursor[key], descending))
            equal = equal & F.col(f"`{key}`").eqNullSafe(F.lit(cursor[key]))
        key, descending = keys[0]
        if cursor[key] is not None:  # implied by the rest, and what a scan can skip files by
            c = F.col(f"`{key}`")
            df = df.where((c <= cursor[key]) | c.isNull() if descending else c >= cursor[key])
        df = df.where(later)
    return df.orderBy(*[(F.desc if d else F.asc)(f"`{k}`") for k, d in keys]).limit(size)


def as_of(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, name: str = "found") -> DataFrame:
    """``left`` with ``name``, the last row of ``right`` (a struct) of its key that is not later than it.

    Both are laid out in one order by key and time; values are carried forward within a range of it, and the
    last value of each range and key is handed on to the ranges after it. A hot key is cut like any other.
    Defined results: rows of ``right`` without key or time match nothing; rows of ``left`` without them are
    kept with null; of equal times the row of ``right`` that is greatest by its columns in their order is
    taken; repeated rows of ``left`` are all kept; either side may be empty.
    """
    l, r = F.struct(*_cols(left.columns)), F.struct(*_cols(right.columns))
    old = right.where(F.col(right_at).isNotNull() & F.col(on).isNotNull())
    rows = left.select(F.col(on).alias("k"), F.col(left_at).alias("at"), l.alias("l"), F.lit(None).cast(old.select(r.alias("r")).schema["r"].dataType).alias("r"))
    rows = rows.unionByName(old.select(F.col(on).alias("k"), F.col(right_at).alias("at"), F.lit(None).cast(rows.schema["l"].dataType).alias("l"), r.alias("r")))
    rows, part, row = laid_out(rows, F.col("at"), F.col("l").isNotNull(), F.col("r"), within=("k",))
    carried = F.last("r", ignorenulls=True).over(Window.partitionBy(part, "k").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("r is not null").groupBy(part, "k").agg(F.max_by("r", row).alias("end"))
    heads = rows.where("l is not null").select(part, "k").distinct()  # ranges that ask, beside those that hold a value
    ends = ends.join(heads, [part, "k"], "full")
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("k").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select(part, "k", before.alias("before")).where("before is not null")
    seen = rows.select(part, "k", "at", "l", carried.alias("in_range")).where("l is not null")
    found = F.when(F.col("at").isNotNull(), F.coalesce("in_range", "before"))
    return seen.join(handed, [part, "k"], "left").select("l.*", found.alias(name))


def sessions(df: DataFrame, key: str, at: str, gap_seconds: float) -> DataFrame:
    """(key, start, end, rows) of each session: rows of a key of which none is more than ``gap_seconds`` after the one before.

    ``end`` is the time of the last row. Places where a gap opens are found within ranges of the order by key and
    time; a range's first row of a key looks at the last time that was handed on. Rows without time are left out;
    rows without key are a key of their own.
    """
    rows, part, row = laid_out(df.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at")), F.col("at"), within=("k",))
    near = Window.partitionBy(part, "k").orderBy(row)
    edges = rows.groupBy(part, "k").agg(F.max("at").alias("last"))
    handed = edges.select(part, "k", F.lag("last").over(Window.partitionBy("k").orderBy(part)).alias("handed"))
    rows = rows.withColumn("before", F.lag("at").over(near)).alias("l").join(handed.alias("r"), (F.col(f"l.{part}") == F.col(f"r.{part}")) & F.col("l.k").eqNullSafe(F.col("r.k")))
    rows = rows.select(f"l.{part}", f"l.{row}", "l.k", "l.at", F.coalesce("l.before", "r.handed").alias("before"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    opens = F.col("before").isNull() | (micros("at") - micros("before") > int(gap_seconds * 1_000_000))
    rows = rows.withColumn("opens", opens.cast("long"))
    inner = rows.select(part, "k", "at", F.sum("opens").over(near).alias("n"))
    sums = rows.groupBy(part, "k").agg(F.sum("opens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(part, "k", earlier.alias("earlier"))
    inner = inner.alias("l").join(sums.alias("r"), (F.col(f"l.{part}") == F.col(f"r.{part}")) & F.col("l.k").eqNullSafe(F.col("r.k")))
    out = inner.groupBy(F.col("l.k").alias(key), (F.col("l.n") + F.col("r.earlier")).alias("n")).agg(F.min("l.at").alias("start"), F.max("l.at").alias("end"), F.count("*").alias("rows"))
    return out.drop("n")


def moving_sums(df: DataFrame, key: str, at: str, seconds: float, **sums: str) -> DataFrame:
    """``df`` with sums of whole-number columns over the rows of its key from ``seconds`` before it up to its own time.

    Rows of the same time see each other, as a RANGE frame has it. A row counts from its time on and is taken back
    after ``seconds``, so a moving sum is a running sum of additions and subtractions in the order of time: each
    change is added once, whatever the frame holds, and ranges of the order hand their totals on. Null values
    count as zero; rows without time get null; rows without key are a key of their own.
    """
    now, back = F.unix_micros(F.col(at).cast("timestamp")), int(seconds * 1_000_000)
    values = {n: F.coalesce(F.col(c).cast("long"), F.lit(0)) for n, c in sums.items()}
    timed = df.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), now.alias("t"), *[v.alias(n) for n, v in values.items()])
    # What comes at a time counts at it; what leaves does so right after it.
    came = timed.select("k", (F.col("t") * 2).alias("o"), *sums)
    left = timed.select("k", ((F.col("t") + back) * 2 + 1).alias("o"), *[(-F.col(n)).alias(n) for n in sums])
    changes = came.union(left).groupBy("k", "o").agg(*[F.sum(n).alias(n) for n in sums])
    rows, part, row = laid_out(changes, F.col("o"), within=("k",))
    near = Window.partitionBy(part, "k").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select(part, "k", "o", *[F.sum(n).over(near).alias(n) for n in sums])
    totals = rows.groupBy(part, "k").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy("k").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, "k", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    i, t = inner.alias("i").where("o % 2 = 0"), totals.alias("t")
    running = i.join(t, (F.col(f"i.{part}") == F.col(f"t.{part}")) & F.col("i.k").eqNullSafe(F.col("t.k"))).select("i.k", "i.o", *[(F.col(f"i.{n}") + F.col(f"t.{n}")).alias(n) for n in sums])
    d, s = df.withColumn(free("_o", df.columns), now * 2).alias("d"), running.alias("s")
    met = d.join(s, F.col(f"d.{key}").eqNullSafe(F.col("s.k")) & (F.col(f"d.{free('_o', df.columns)}") == F.col("s.o")), "left")
    return met.select(*[F.col(f"d.`{c}`") for c in df.columns if c not in sums], *[F.col(f"s.{n}") for n in sums])
