"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, its documents in id order within hash buckets, are packed into blocks
of a fixed number of words. A source's target is turned into slots: whole passes over its blocks
and a part of one more pass. Slot ``k`` of a source goes through the source's pseudorandom
permutation, a Feistel network that is walked until it ends at a block, to a block index, and
through a hash to one of the output shards; so the counts of a source over the shards are a
multinomial draw, while each source's sum stays at its target. Slots and blocks are joined by block
index.

Word offsets come from a two-level prefix sum (hash buckets of a source, then documents of a
bucket), so that a source with a third of all rows is spread over many tasks. Sources are numbered in
ranges and their level is found by sums over all of them, so there may be a source for every host.

Defined results
---------------
* null or blank text has size 0; it is in no block, and 0 of its words are taken.
* a null source is a source of its own, last in the order of sources.
* repeated rows count once each in the sizes; rows that are equal in id and text are each given an
  even part of what their words are taken. In ``mixed_documents`` such rows are one document.
* texts may be of any length: only their numbers of words are moved. Ties: the permutation is one to one,
  and of a block that documents share, each gives the words that it has in it.
* no block is taken more than ``CAP`` times, so no document exceeds ``CAP`` times its size.
* an empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.sources.tables import table

#: Words of a block, words of an output shard, times that a block may be taken, and the seed.
BLOCK, SHARD_WORDS, CAP, SEED = 64, 1 << 20, 3, 17
#: Documents of a source that one offset bucket holds, about.
PER_BUCKET = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rounds of a Feistel network, and the most walks through it: all but one in 2**WALKS numbers end sooner, and that one is an error.
ROUNDS, WALKS = 4, 64
#: Walks before the rest of them are taken up.
FEW = 4


def n_words(text: Column) -> Column:
    """Number of runs of anything but space and 0x09 to 0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per source of ``sizes`` (source, source_size, n_docs): its target in words.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all
    sizes. What goes over ``cap`` times a source's size is shared among the others by weight
    until none is above: each round caps the sources that are above the level of the last one.
    """
    keys = [F.col("source").isNull().alias("last"), F.encode("source", "UTF-8").alias("code")]
    dealt = sizes.select("*", *keys).repartitionByRange(*[F.col(c) for c in ("last", "code")]).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "mixing-sources")  # which fixes the parts
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "code")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    plan = dealt.withColumn("inside", inside).join(before, "part").withColumn("i", (F.col("base") + F.col("inside")).cast("int")).withColumn("w", weight)
    plan = written(plan.withColumn("most", (cap * F.col("source_size")).cast("double")).select("source", "i", "source_size", "n_docs", "w", "most"), "mixing-weights")
    level, capped, total = -1.0, -1, plan.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.col("most") < F.lit(level) * F.col("w")
        now, words, left = plan.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not left or now == capped:  # none is left below its cap, or none is newly above it
            break
        level, capped = (total - words) / left, now
    target = F.col("most") if not left else F.least("most", F.col("w") * F.lit(level))
    return plan.select("source", "i", "source_size", "n_docs", target.alias("target"))


def permuted(x: Column, n: Column, bits: Column, key: Column) -> Column:
    """Place of ``x`` in a pseudorandom permutation of the numbers below ``n``; ``bits`` is how many bits n - 1 takes.

    A Feistel network, its halves of unequal width where ``bits`` is odd, permutes all numbers of so many bits,
    fewer than 2 n. Where it ends above n, it is walked again from there, so numbers below n are permuted among
    themselves. Fewer than half of the steps stay outside; one that is still there after ``WALKS`` is an error.
    """
    two = lambda b: F.pow(F.lit(2.0), b).cast("long")
    low = two(F.ceil(bits / 2))
    masks = two(F.floor(bits / 2)) - 1, low - 1

    def network(v: Column) -> Column:
        left, right = F.floor(v / low).cast("long"), v.bitwiseAND(masks[1])
        for r in range(ROUNDS):  # an even number, so that the halves have their own widths at the end
            left, right = right, left.bitwiseXOR(F.xxhash64(key, right, F.lit(r)).bitwiseAND(masks[r % 2]))
        return left * low + right

    def walk(v: Column, steps: int) -> Column:
        return F.aggregate(F.array(*[F.lit(k) for k in range(steps)]), v, lambda v, _: F.when(v < n, v).otherwise(network(v)))

    def rest(v: Column) -> Column:  # one in 2**FEW numbers at most comes here
        last = F.aggregate(F.array(walk(v, WALKS - FEW)), F.lit(-1).cast("long"), lambda _, v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a slot of the mix ended on no block")).cast("long")))
        return F.when(v < n, v).otherwise(last)

    once = network(x)
    return F.when(once < n, once).otherwise(F.transform(F.array(walk(once, FEW)), rest)[0])


def _offsets(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents (key, source index i, size) with the word offset ``start`` in their source."""
    docs = docs.join(plan.select("i", "n_docs", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    bucket = F.pmod(F.xxhash64("key", F.lit(SEED)), F.floor(F.col("n_docs") / PER_BUCKET) + 1)
    docs = docs.withColumn("bucket", bucket).select("doc_id", "key", "i", "bucket", "size")
    sums = docs.groupBy("i", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("i", "bucket", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"))
    inner = Window.partitionBy("i", "bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(base, ["i", "bucket"])
        .select("doc_id", "key", "i", "size", (F.col("base") + F.col("inside")).alias("start"))
    )


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source).

    Returns ``(slots, pieces, sized)``. slots: ``source_no, slot, block, shard``, one row for each
    block that the mix takes. pieces: ``doc_id, key, source_no, block, from_word, n_words``, the
    part of a document in a block; joined with slots by ``(source_no, block)`` it is the mix.
    sized: ``doc_id, key, source, size, source_size, target``; key tells apart rows of one id.
    """
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    sized = written(docs.select("doc_id", key.alias("key"), "source", n_words(F.col("text")).alias("size")), "mixing-sizes")
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))), "mixing-targets")
    placed = _offsets(sized, plan)
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    first = F.greatest(F.col("start"), F.col("block") * block)
    pieces = (
        placed.where("size > 0")
        .withColumn("block", blocks)
        .select(
            "doc_id", "key", F.col("i").alias("source_no"), "block",
            (first - F.col("start")).alias("from_word"),
            (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - first).alias("n_words"),
        )
    )
    # Slots: whole passes, then a part of one; a slot is a place in the permutation of its source.
    n_blocks = F.ceil(F.col("source_size") / block)
    passes = F.floor(F.col("target") / F.col("source_size"))
    part = F.round((F.col("target") - passes * F.col("source_size")) / block)
    shards = F.lit(max(1, -(-int(plan.agg(F.sum("target")).first()[0] or 0) // shard_words)))
    wide = 1 << 16  # slots come in runs, so that one source's are made by many tasks
    slots = (
        plan.where("source_size > 0")
        .withColumn("shards", shards)
        .withColumn("n_blocks", n_blocks)
        .withColumn("n_slots", (passes * n_blocks + F.least(part, n_blocks)).cast("long"))
        .withColumn("bits", F.length(F.bin(F.col("n_blocks") - 1)))
        .withColumn("key", F.xxhash64("source", F.lit(seed + 1)))
        .where("n_slots > 0")
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / wide))))
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "run")  # by number, as Spark would put these few bytes into one task
        .withColumn("slot", F.explode(F.sequence(F.col("run") * wide, F.least((F.col("run") + 1) * wide, F.col("n_slots")) - 1)))
        .select(
            F.col("i").alias("source_no"), "slot",
            permuted(F.pmod(F.col("slot"), F.col("n_blocks")), F.col("n_blocks"), F.col("bits"), F.col("key")).alias("block"),
            F.pmod(F.xxhash64("i", "slot", F.lit(seed + 2)), F.col("shards")).alias("shard"),
        )
    )
    sized = sized.join(
        plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    return slots, pieces, sized


def _uses(slots: DataFrame) -> DataFrame:
    """Times that each block is taken. The hint keeps Spark from broadcasting what it takes for small:
    its size estimate is that of the table of sources, before the slots are made."""
    return slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses")).hint("merge")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slots, pieces, sized = mix(docs)
    taken = (
        pieces.join(_uses(slots), ["source_no", "block"], "left")
        .groupBy("key")
        .agg(F.sum(F.col("n_words") * F.coalesce("uses", F.lit(0))).alias("words"), F.sum("n_words").alias("of"))
    )
    share = F.floor(F.col("words") * F.col("size") / F.col("of"))
    return sized.join(taken, "key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``.

    A document that is taken whole comes as it is, once for each time. Where a last time takes
    only some of its blocks, one more row holds these words, in order, joined by single spaces.
    ``n_chars``, where there is such a column, follows the text. Documents of which nothing is
    taken go, as the targets ask for.
    """
    ids = docs.select(F.xxhash64("doc_id", "text").alias("k"))
    if not ids.groupBy("k").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    slots, pieces, _ = mix(docs.select("doc_id", "text", "source"))
    cut = (
        pieces.join(_uses(slots), ["source_no", "block"])
        .groupBy("key")
        .agg(F.min("uses").alias("_low"), F.max("uses").alias("_high"), F.sum("n_words").alias("_seen"),
             F.array_sort(F.collect_list(F.struct("from_word", "n_words", "uses"))).alias("_cuts"))
    )
    own = {"_key", "_low", "_high", "_seen", "_cuts", "_time"}
    aside = uuid.uuid4().hex  # columns of these names have others meanwhile
    plain = docs.toDF(*[f"{aside}{i}" if c.lower() in own else c for i, c in enumerate(docs.columns)])
    keyed = plain.withColumn("_key", F.xxhash64("doc_id", "text", F.lit(SEED)))
    out = keyed.join(cut.withColumnRenamed("key", "_key"), "_key")
    # Blocks that no slot takes are not among the cuts: then no time takes the document whole.
    whole = F.when(F.col("_seen") < n_words(F.col("text")), F.lit(0)).otherwise(F.col("_low"))
    out = out.withColumn("_low", whole).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_high"))))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kept = F.filter("_cuts", lambda c: c["uses"] >= F.col("_time"))
    text = F.when(F.col("_time") <= F.col("_low"), F.col("text")).otherwise(
        F.array_join(F.flatten(F.transform(kept, lambda c: F.slice(words, (c["from_word"] + 1).cast("int"), c["n_words"].cast("int")))), " ")
    )
    out = out.withColumn("text", text)
    if "n_chars" in plain.columns:
        out = out.withColumn("n_chars", F.when(F.col("_time") <= F.col("_low"), F.col("n_chars")).otherwise(F.length("text")).cast(plain.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in plain.columns]).toDF(*docs.columns)
