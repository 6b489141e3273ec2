"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets a 60-bit hash. The directory is indexed by the first bits of the hash. A bucket
that holds more bytes than the limit is split on its next bit, any other bucket stays as it is,
until every bucket fits. So the depth of a bucket follows the bytes in it, and hot ranges of the
hash cost deeper buckets there and nowhere else.

Defined results
---------------
* null text counts 0 bytes; null ids are hashed as text that no id has.
* one row larger than the limit gets a bucket of its own and goes over the limit.
* rows that are equal in id and text share all 60 bits, so no bit can part them. Where they
  exceed the limit together, they go into an overflow chain: ``shard_id`` then ends in
  ``+number``, with as many rows a link as fit. Ties between them are broken by a hash of all columns,
  so another partitioning gives the same links; columns of a table with such rows must be comparable.
* texts may be of any length: only their bytes are counted.
* existing columns called like the results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import without, written
from tidewright.sources.tables import table

BITS = 60
#: Bytes of text a shard may hold.
LIMIT = 1 << 20
#: Rows of a chain that one task makes.
RUN = 1 << 16


def hash60(*parts: Column) -> Column:
    """The first 15 hex digits of an MD5 over the parts, as a number of 60 bits."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _nodes(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes, rows and hash range of each bucket of depths ``low`` to ``high``, from summed cells."""
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    return (
        cells.select("lo", "hi", "bytes", "rows", depth)
        .withColumn("prefix", F.expr(f"shiftright(lo, {BITS} - depth)"))
        .groupBy("depth", "prefix")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    )


def _summed(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def _first_fit(cells: DataFrame, nodes: DataFrame, cell_depth: int, low: int, limit: int) -> DataFrame:
    """For each cell the shallowest bucket over it that needs no split, if there is one."""
    fits = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
    fitting = nodes.where(fits).select("depth", "prefix", F.col("bytes").alias("b"), F.col("rows").alias("r"))
    return (
        cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(cell_depth))).alias("depth"))
        .withColumn("prefix", F.expr(f"shiftright(cell, {cell_depth} - depth)"))
        .join(fitting, ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "prefix", "b", "r")).alias("leaf"))
    )


def shard(docs: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("doc_id", "text"), text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``shard_id`` (the bucket's bits), ``depth``, ``shard_bytes``, ``shard_docs``."""
    if limit < 1:
        raise ValueError("limit must be at least 1 byte")
    docs = without(docs, "n_bytes", "shard_id", "depth", "shard_bytes", "shard_docs", "_h", "_cell", "_leaf")
    h = hash60(*[F.col(k) for k in keys])
    n = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(h.alias("h"), n.alias("n"))

    # The directory: cells of the first bits, about 8 of them for each shard.
    total = rows.agg(F.sum("n")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + 3)
    cells = written(
        _summed(rows, F.shiftright("h", BITS - depth).alias("cell")), "sharding-cells"
    )
    leaves = _first_fit(cells, _nodes(cells, 0, depth), depth, 0, limit)
    directory = written(cells.join(leaves, "cell", "left").select("cell", "leaf"), "sharding-directory")

    out = docs.withColumn("_h", h).withColumn("n_bytes", n).withColumn("_cell", F.shiftright("_h", BITS - depth))
    out = out.join(directory.select(F.col("cell").alias("_cell"), F.col("leaf").alias("_leaf")), "_cell", "left")
    if depth < BITS and not directory.where("leaf is null").isEmpty():
        # Some cells are over the limit: their rows, and only these, take the remaining bits.
        deep = written(
            _summed(
                rows.withColumn("c", F.shiftright("h", BITS - depth)).join(
                    directory.where("leaf is null").select(F.col("cell").alias("c")), "c", "left_semi"
                ),
                F.col("h").alias("cell"),
            ),
            "sharding-deep",
        )
        low = depth + 1
        deeper = _first_fit(deep, _nodes(deep, low, BITS), BITS, low, limit)
        out = (
            out.join(deeper.select(F.col("cell").alias("_h"), F.col("leaf").alias("_deeper")), "_h", "left")
            .withColumn("_leaf", F.coalesce("_leaf", "_deeper"))
            .drop("_deeper")
        )
    bits = F.expr("substring(lpad(bin(_leaf.prefix), 64, '0'), 65 - _leaf.depth, _leaf.depth)")
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_bytes",
        F.when(F.col("_leaf.depth") == 0, F.lit("")).otherwise(bits).alias("shard_id"),
        F.col("_leaf.depth").cast("long").alias("depth"),
        F.col("_leaf.b").alias("shard_bytes"),
        F.col("_leaf.r").alias("shard_docs"),
        F.col("_h"),
    )
    over = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if cells.where((F.col("bytes") > limit) & (F.col("rows") > 1)).isEmpty() or out.where(over).limit(1).isEmpty():
        return out.drop("_h")
    # Overflow chains: equal rows are counted, and numbers are dealt to the counts, so that no row has to be
    # told from its copies, the links do not depend on partitions, and a hot row is counted in parts.
    cols = out.columns
    per_link = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))).cast("long")
    chained = out.where(over).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_h").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in cols])).rowsBetween(Window.unboundedPreceding, -1)
    chained = chained.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chained = chained.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN)))).repartition("_h", "_run")
    chained = chained.withColumn("_at", F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, F.col("_n")) - 1)))
    link = F.floor((F.col("_base") + F.col("_at")) / per_link)
    rows = F.least(per_link, F.col("shard_docs") - link * per_link)
    chained = chained.select(*[F.col(f"`{c}`") for c in cols if c not in ("shard_id", "shard_docs", "shard_bytes")], F.concat("shard_id", F.lit("+"), link).alias("shard_id"), rows.alias("shard_docs"), (rows * F.col("n_bytes")).alias("shard_bytes"))
    return out.where(~over).unionByName(chained.select(*[F.col(f"`{c}`") for c in cols])).drop("_h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes", "shard_docs")


SQL = f"""
with s as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n,
         ('0x' || substr(md5(coalesce(doc_id::varchar, chr(0)) || ':' || coalesce(text, chr(0))), 1, 15))::bigint as h
  from documents
), nodes as (
  select d, h >> ({BITS} - d) as p, sum(n)::bigint as b, count(*)::bigint as r
  from s, (select unnest(range(0, {BITS + 1}))::int as d)
  group by all having sum(n) <= {LIMIT} or min(h) = max(h)
), leaf as (
  select s.doc_id, s.n, s.h, min(d) as depth
  from s, nodes where nodes.p = s.h >> ({BITS} - d) group by all
)
select leaf.doc_id, n as n_bytes,
       right(lpad(bin(h >> ({BITS} - depth)), 64, '0'), depth) as shard_id,
       depth::bigint as depth, b as shard_bytes, r as shard_docs
from leaf join nodes on d = depth and p = h >> ({BITS} - depth)
"""
