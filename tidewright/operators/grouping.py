"""Grouped sums over many sets of dimensions, and sketches that are kept and merged."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_sets(dims: list[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def cube_sets(dims: list[str]) -> list[tuple[str, ...]]:
    return [x for n in range(len(dims), -1, -1) for x in combinations(dims, n)]


def grouped(df: DataFrame, dims: list[str], sets: list[tuple[str, ...]], distinct: str, **sums: str) -> DataFrame:
    """``dims``, ``grouping_id``, ``distinct_<column>`` and sums of columns for each set of dimensions.

    Rows are first summed by all dimensions and the column whose values are counted, so that what is multiplied
    by the number of sets is already small; then by each set and value; then by each set. A set's bit in
    grouping_id is 1 for each dimension it lacks, the first dimension's the highest. A null in a dimension is a
    group of its own, told from a dimension that is lacking by grouping_id; null values are not counted; an empty
    table has one row for the empty set, as SQL has it, with null sums.
    """
    fine = df.groupBy(*dims, distinct).agg(*[F.sum(c).alias(f"s_{n}") for n, c in sums.items()])
    bit = {c: 1 << (len(dims) - 1 - i) for i, c in enumerate(dims)}
    gids = [sum(bit[c] for c in dims if c not in x) for x in dict.fromkeys(sets)]
    spread = fine.withColumn("grouping_id", F.explode(F.array(*[F.lit(g).cast("long") for g in gids])))
    part = [F.when(F.col("grouping_id").bitwiseAND(F.lit(bit[c])) == 0, F.col(c)).alias(c) for c in dims]
    by_value = spread.select("grouping_id", *part, distinct, *[f"s_{n}" for n in sums]).groupBy("grouping_id", *dims, distinct).agg(*[F.sum(f"s_{n}").alias(f"s_{n}") for n in sums])
    out = by_value.groupBy("grouping_id", *dims).agg(F.count(distinct).alias(f"distinct_{distinct}"), *[F.sum(f"s_{n}").alias(n) for n in sums])
    if () not in sets:
        return out
    # With no rows at all, the empty set still has its row.
    whole = df.agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("rows")).where("rows = 0")
    none = [F.lit(max(gids)).cast("long").alias("grouping_id"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in dims], F.lit(0).cast("long").alias(f"distinct_{distinct}"), *sums]
    return out.unionByName(whole.select(*none))


#: Registers of a distinct-count sketch are 2**LG; its standard error is about 1.04 / 2**(LG / 2), 1.6 %.
LG = 12
#: Rows and columns of a count-min sketch: estimates exceed counts by more than 2 N / COLUMNS with probability 2**-ROWS.
ROWS, COLUMNS = 5, 2048


def sketches(df: DataFrame, keys: list[Column], counted: str, measured: str) -> DataFrame:
    """By ``keys``, a sketch of the distinct values of ``counted`` and one of the distribution of ``measured`` (whole numbers).

    Sketches are a few KB each whatever they hold, and are merged without the rows; nulls are left out.
    """
    held = F.hll_sketch_agg(counted, F.lit(LG)).alias("distinct_sketch")
    return df.groupBy(*keys).agg(held, F.kll_sketch_agg_bigint(F.col(measured).cast("long")).alias("quantile_sketch"), F.count("*").alias("rows"))


def merged_sketches(kept: DataFrame, *keys: Column) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return kept.groupBy(*keys).agg(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch"), F.sum("rows").alias("rows"))


def _cells(value: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("r"), F.pmod(F.xxhash64(F.lit(r), value), F.lit(COLUMNS)).cast("int").alias("c")) for r in range(ROWS)])


def count_min(df: DataFrame, keys: list[Column], value: str) -> DataFrame:
    """(keys, r, c, n): cells of a count-min sketch of ``value`` by ``keys``, at most ROWS x COLUMNS a group; merged by summing n."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    names = [c for c in rows.columns if c not in (value, "n")]
    return rows.select(*names, "n", F.explode(_cells(F.col(value))).alias("x")).groupBy(*names, F.col("x.r").alias("r"), F.col("x.c").alias("c")).agg(F.sum("n").alias("n"))


def estimated(cells: DataFrame, keys: list[str], asked: DataFrame, value: str) -> DataFrame:
    """(keys, value, estimate) for the rows (keys, value) of ``asked``: never below the true count."""
    probes = asked.select(*keys, value, F.explode(_cells(F.col(value))).alias("x")).select(*keys, value, "x.r", "x.c")
    met = probes.join(cells, [*keys, "r", "c"], "left")
    return met.groupBy(*keys, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
