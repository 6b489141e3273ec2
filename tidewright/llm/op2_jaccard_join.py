"""N-gram Jaccard join by a size-aware heavy-light join, and the groups it links.

A text's set holds its distinct word shingles. Sets of the same shingles are one node, so exact
copies are met once. Two sets of sizes a and b with Jaccard similarity t or more differ in at
most H = (a + b)(1 - t)/(1 + t) shingles. From this both sides of the join follow:

* light (small) sets enumerate subsets: a pair shares its common part, and each side gets there
  by leaving out at most E(size) shingles, so every subset of that many or more is a key.
* heavy (large) sets are scanned through inverted lists. A list is kept for a block of the
  shingle space, not for a single shingle: sets are cut by hash into H + 1 blocks, of which at
  least one is the same in both sets of a pair. So a passage that many documents share makes no
  long list, only sets that are nearly alike meet. Blocks are laid out by size level, and each
  set is listed under its own level and the one below.
* the boundary is where the cost of keys and of verifying what they bring is the same
  (``boundary``); sets up to 1/t above it also enumerate subsets, as partners of light ones.

The parity sketches of two sets give a lower bound of the sets' difference, so a pair whose bound is
above H is turned down before any text is moved. Every member of a list is compared with the
list's first member, which needs a number of pairs that is linear in the lists, and verified by the
shingles of both texts. Only where a list still holds more than one connected group are its sets
brought together, in cells of bounded size, and those outside its main group compared with all.
A cell returns a forest: no more links than it has groups, whatever the number of pairs.
Links within a group that is known to be connected change no component, so the result is that of
comparing all pairs.

Defined results
---------------
* null, empty or blank texts have no shingles and are linked with nothing.
* fewer words than a shingle has: the whole sequence is one shingle.
* repeated rows are copies: each gets a row. A row with a null id is linked with nothing and has a
  null component.
* shingles and sets are known by 64-bit hashes.
* a text may be of any length: it is hashed whole, in pieces. A set takes 8 bytes a shingle in a cell,
  and one set larger than a cell is in cells of its own size.
* ties: of a group, the smallest id names it and stays; which of equal texts brought it plays no part.
* an empty table gives an empty table. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.graph import components, least_of
from tidewright.llm.shared import shards_of, without, written
from tidewright.llm.tokens import blob, each_run, joined, mix, packed, shard_of
from tidewright.sources.tables import table

#: Sets, and shingles, of a list that one cell of further pairs takes from either side, about.
CELL, CELL_SHINGLES = 4096, 1 << 20
#: Shingles of all sets for each shard of the lists.
SHARD_SHINGLES = 1 << 22
#: Weight of verifying a pair against that of one key, in ``boundary``.
VERIFY = 16
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Bounds:
    """What a similarity threshold implies for set sizes. ``t`` is exact, e.g. Fraction(9, 10)."""

    def __init__(self, t: Fraction):
        self.t = t

    def differ(self, total: int) -> int:
        """The most shingles in which two linked sets of ``total`` shingles together differ."""
        return int(total * (1 - self.t) / (1 + self.t))

    def largest(self, n: int) -> int:
        return int(n / self.t)

    def left_out(self, n: int) -> int:
        """E: the most shingles that a set of size n leaves out to get to a common part."""
        return max((self.differ(n + b) + n - b) // 2 for b in range(math.ceil(n * self.t), self.largest(n) + 1))

    def levels(self, n: int) -> list[int]:
        """First sizes of the levels up to the one after that of n."""
        out = [1]
        while len(out) < 2 or out[-2] <= n:
            out.append(max(out[-1] + 1, self.largest(out[-1]) + 1))
        return out

    def blocks(self, top: int) -> int:
        """Blocks of a level whose largest set has ``top`` shingles."""
        return self.differ(top + self.largest(top)) + 1

    def boundary(self) -> int:
        """The largest size at which enumerating subsets costs no more than scanning lists."""
        best = n = 0
        while n < 64:
            n += 1
            light = sum(math.comb(n, e) for e in range(self.left_out(n) + 1))
            blocks = self.blocks(n)
            if light <= 2 * blocks * (1 + VERIFY * blocks / n):
                best = n
            elif light > 4096:
                break
        return best


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each row."""
    for i, j, w, at in each_run(column):
        if len(w) >= k:
            h = np.zeros(len(w) - k + 1, np.uint64)
            for c in range(k):
                h = mix(h * _C[3] + w[c : len(w) - k + 1 + c] * _C[c % 3] + np.uint64(c))
        for r in range(i, j):
            a, b = int(at[r - i]), int(at[r - i + 1])
            if b - a >= k:
                yield r, np.unique(h[a : b - k + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)  # of one element, as single numbers warn of overflow
                for x in w[a:b]:
                    short = mix(short * _C[3] + x)
                yield r, short
            else:
                yield r, np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """The number by which a set is known."""
    return int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set over as many bits as it has shingles, about: 64 to 8192."""
    bits = min(8192, 1 << max(6, (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little")


class Keys:
    """Keys by which a set meets those it may be linked with."""

    def __init__(self, t: Fraction):
        self.bounds = Bounds(t)
        self.small = self.bounds.boundary()
        self.reach = self.bounds.largest(self.small)
        self.first = self.bounds.levels(1 << 12)

    def of(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        if n <= self.reach:
            out.append(self.subsets(s))
        if n > self.small:
            while self.first[-2] <= n:
                self.first = self.bounds.levels(2 * n)
            level = int(np.searchsorted(self.first, n, "right")) - 1
            out += [self.lists(s, x) for x in ((level, level - 1) if level else (level,))]
        return np.concatenate(out)

    def subsets(self, s: np.ndarray) -> np.ndarray:
        """Hashes of all subsets that leave out up to E shingles; a subset is known by sum and size."""
        sums = [np.array([mix(s).sum()], np.uint64)]
        single, left = mix(s), [(sums[0], np.array([-1]))]
        for e in range(self.bounds.left_out(len(s))):
            total, last = left[-1]
            if e + 1 >= len(s):
                break
            at, j = np.array([(x, j) for x, i in enumerate(last) for j in range(i + 1, len(s))], np.int64).reshape(-1, 2).T
            left.append((total[at] - single[j], j))
        return np.concatenate([mix(x ^ (np.array(_C[:1]) * np.uint64(2 * (len(s) - e) + 1))) for e, (x, _) in enumerate(left)])

    def lists(self, s: np.ndarray, level: int) -> np.ndarray:
        """Hashes of the set's part in each block of a level; the level and the block belong to the key."""
        m = self.bounds.blocks(self.first[level + 1] - 1)
        block = ((s >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ _C[1])[order])])
        ends = np.searchsorted(block[order], np.arange(m), "right")
        part = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        return mix(part * _C[2] + np.arange(m, dtype=np.uint64) * _C[3] + np.uint64(2 * level))


#: Bytes of a key that are sent to its shard, which follows from the others. Keys that agree in
#: these only bring a pair that verification turns down.
KEY_BYTES = 6


def _nodes(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Node and set of each row of (id, text); no node without id or shingles."""
    ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    for r, s in shingle_sets(batch.column(1), k):
        yield (node_of(s) if len(s) and ids[r] else None), s


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """(id, text_key, node, n_shingles, sketch) of each row of (id, text, text_key); sketches once for each node of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int | None] = {None}
            out = []
            for x, s in _nodes(batch, k):
                out.append((x, len(s), None if x in seen else blob(sketch(s))))
                seen.add(x)
            cols = zip(*out, strict=True) if out else [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), *arrays], names=["id", "text_key", "node", "n_shingles", "sketch"])

    return docs.mapInArrow(run, "id long, text_key long, node long, n_shingles long, sketch binary")


def _posted(docs: DataFrame, k: int, t: Fraction, shards: int) -> DataFrame:
    """Packed postings by shard: nodes, how many keys each has there, and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(t)
        for batch in batches:
            found = {x: keys.of(s) for x, s in _nodes(batch, k) if x is not None}
            if not found:
                continue
            node = np.repeat(np.fromiter(found, np.int64, len(found)), [len(v) for v in found.values()])
            key = np.concatenate(list(found.values()))
            out = []
            for shard, p in packed(np.arange(len(key)), shard_of(key, shards), shards):
                first = np.flatnonzero(np.append(True, node[p][1:] != node[p][:-1]))
                short = key[p].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                out.append((shard, blob(node[p][first]), blob(np.diff(np.append(first, len(p))).astype(np.int32)), blob(short)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "nodes", "counts", "keys"])

    return docs.mapInArrow(run, "shard int, nodes binary, counts binary, keys binary")


def _met(group: pa.Table) -> pa.Table:
    """Of one shard's postings the lists of two nodes or more: key, node, first node."""
    nodes = np.repeat(joined(group.column("nodes"), np.int64), joined(group.column("counts"), np.int32))
    keys = np.zeros((len(nodes), 8), np.uint8)
    keys[:, :KEY_BYTES] = joined(group.column("keys"), np.uint8).reshape(-1, KEY_BYTES)
    keys = keys.view(np.int64).ravel()
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    _, start, count = np.unique(keys, return_index=True, return_counts=True)
    many = np.repeat(count > 1, count)
    head = np.repeat(nodes[start], count)
    out = np.unique(np.stack([head[many], nodes[many]]), axis=1)
    return pa.table({"head": out[0], "node": out[1]})


def _possible(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow for the threshold."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    bounds = Bounds(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, sa, nb, sb in zip(*batch.columns[2:], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (sa, sb))
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
                ok.append(int(np.bitwise_count(x ^ y).sum()) <= bounds.differ(na.as_py() + nb.as_py()))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.cast(pa.large_binary()).combine_chunks()


def _folded(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches of several widths as rows of the smallest."""
    sk = [np.frombuffer(v.as_buffer(), np.uint64) for v in _one(column)]
    width = min(map(len, sk))
    return np.stack([np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in sk])


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, text) of each node of ``wanted`` (node)."""
    wanted = written(nodes.join(wanted, "node").select(F.col("rep").alias("id"), "node"), "jaccard-wanted")

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a row of the same id may have another text
            yield batch.filter(pa.array([n.as_py() == x for n, (x, _) in zip(batch.column(0), _nodes(batch, k), strict=True)], pa.bool_()))

    texts = docs.join(wanted, "id").select("node", "text").mapInArrow(own_text, "node long, text string")
    return written(texts.dropDuplicates(["node"]), "jaccard-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sets reach the threshold."""
    pairs = written(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    own = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), nodes, docs, k)
    # A node with many pairs is met in copies of its text, each with a bounded part of the pairs.
    spread = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / 256) + 1).alias("copies"))
    left = spread.join(own, spread.a == own.node).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("text").alias("ta"))
    right = pairs.join(spread, "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = right.withColumn("copy", F.pmod(F.xxhash64("b"), "copies")).join(left, ["a", "copy"]).select("a", "b", "ta", "tb")
    num, den = t.numerator, t.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for (_, x), (_, y) in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                ok.append(den * common >= num * (len(z) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return written(both.mapInArrow(check, "a long, b long"), "jaccard-links")


def _across(lists: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(a, b): links that connect all groups which are linked within a list.

    Lists of one first member are taken together, so that sets that are in many of them, as near
    copies are, meet once. Most members of a list are in its main group by now; each of the others is
    compared with all members. For this the list is cut into parts of bounded bytes, and a cell
    holds two parts: first their sketches, which leave those sets that may have a link at all, and
    then these sets. It returns no more links than it has groups, as two groups are not compared any
    further once a link between them is found.
    """
    rows = lists.withColumnRenamed("head", "key").join(groups.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    rows = written(rows.join(nodes.select("node", "n_shingles"), "node"), "jaccard-listed")
    by_group = rows.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("words"))
    whole = by_group.groupBy("key").agg(F.max(F.struct("n", "group")).alias("m"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.max(F.struct("n", "group", "words"))["words"].alias("own"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts = lambda n, words: (F.greatest(F.floor(n / CELL), F.floor(words / CELL_SHINGLES)) + 1).cast("long")
    mixed = whole.select("key", F.col("m")["group"].alias("main"), parts(F.col("n") - F.col("m")["n"], F.col("words") - F.col("own")).alias("xs"), parts(F.col("n"), F.col("words")).alias("ys"))
    mixed = written(mixed, "jaccard-mixed")
    if mixed.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows = rows.join(mixed, "key")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    others = rows.where(F.col("group") != F.col("main")).withColumn("x", part("xs")).withColumn("y", each("ys")).withColumn("other", F.lit(True))
    every = rows.withColumn("y", part("ys")).withColumn("x", each("xs")).withColumn("other", F.lit(False))
    placed = others.unionByName(every).select("key", "x", "y", "node", "group", "main", "other")

    def packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [blob(s) for _, s in shingle_sets(batch.column(1), k)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    num, den, ratio = t.numerator, t.denominator, (1 - t) / (1 + t)

    def near(i: int, size: np.ndarray, sk: np.ndarray) -> np.ndarray:
        """Whether the sketches allow for a link with set i."""
        return np.bitwise_count(sk[i] ^ sk).sum(axis=1) <= ((size[i] + size) * ratio.numerator) // ratio.denominator

    def wanted(rows: pa.Table) -> pa.Table:
        other, of, size = rows.column("other").to_numpy(zero_copy_only=False), rows.column("group").to_numpy(), rows.column("n_shingles").to_numpy()
        sk, keep = _folded(rows.column("sketch")), np.zeros(len(rows), bool)
        for i in np.flatnonzero(other):
            hit = ~other & (of != of[i]) & near(i, size, sk)
            keep |= hit
            keep[i] = hit.any()
        return rows.filter(pa.array(keep)).drop_columns(["sketch", "n_shingles"])

    shape = "key long, x long, y long, node long, group long, main long, other boolean"
    told = placed.join(nodes.select("node", "n_shingles", "sketch"), "node").select("key", "x", "y", "node", "group", "main", "other", "n_shingles", "sketch")
    placed = written(told.groupBy("key", "x", "y").applyInArrow(wanted, shape), "jaccard-near")
    texts = _texts(placed.select("node").distinct(), nodes, docs, k)
    sets = written(texts.mapInArrow(packed_sets, "node long, shingles binary").join(nodes.select("node", "sketch"), "node"), "jaccard-sets")

    def cell(rows: pa.Table) -> pa.Table:
        node, other = rows.column("node").to_numpy(), rows.column("other").to_numpy(zero_copy_only=False)
        ids, of = np.unique(rows.column("group").to_numpy(), return_inverse=True)
        label, main = np.arange(len(ids)), np.flatnonzero(ids == rows.column("main")[0].as_py())
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in _one(rows.column("shingles"))]
        size = np.array([len(v) for v in sets])
        sk = _folded(rows.column("sketch"))
        twice = other | ~np.isin(of, main)  # pairs of these come from both of their ends
        links = []
        for i in np.flatnonzero(other):
            some = np.flatnonzero(~other & (label[of] != label[of[i]]) & near(i, size, sk) & (~twice | (node > node[i])))
            for j in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) >> 18)) + 1):
                j = j[label[of[j]] != label[of[i]]]
                if not len(j):
                    continue
                theirs = np.concatenate([sets[x] for x in j])
                at = np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)
                common = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), np.cumsum(size[j]) - size[j])
                for x in j[den * common >= num * (size[i] + size[j] - common)]:
                    if label[of[x]] != label[of[i]]:
                        label[label == label[of[x]]] = label[of[i]]
                        links.append((node[i], node[x]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = placed.join(sets, "node").groupBy("key", "x", "y").applyInArrow(cell, "a long, b long")
    return written(found, "jaccard-across")


def jaccard_groups(docs: DataFrame, k: int, t: Fraction, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id`` (the smallest key linked), ``text_key``
    (a hash of the text), ``node`` and ``group`` (hashes of the row's set and of its group, null without one)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = written(_rows(docs.withColumn("text_key", F.xxhash64("text")), k), "jaccard-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    nodes = written(nodes, "jaccard-nodes")
    words = rows.agg(F.sum("n_shingles")).first()[0] or 0
    met = _posted(docs, k, t, shards_of(spark, 1, words, SHARD_SHINGLES)).groupBy("shard").applyInArrow(_met, "head long, node long")
    lists = written(met.distinct(), "jaccard-lists")
    star = lists.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = _verified(_possible(star, nodes, t), nodes, docs, k, t)
    groups = written(components(links), "jaccard-groups")
    more = _across(lists, groups, nodes, docs, k, t)
    if not more.isEmpty():
        groups = written(components(links.union(more)), "jaccard-groups")
    least = least_of(groups, nodes.select("node", F.col("rep").alias("value")))
    by_node = nodes.select("node", "rep").join(least.join(groups, "node"), "node", "left")
    by_node = by_node.select("node", F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "node").alias("group"))
    return (
        rows.drop("sketch").join(by_node, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(F.col("id").alias(key), "n_shingles", "component_id", "text_key", "node", "group")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents under 3-word shingles and similarity 0.9."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs, 3, Fraction(9, 10)).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id (of rows of one id, that of the smallest hash).

    Rows without an id or without shingles stay. Rows that are equal in id and text are one document.
    """
    groups = written(jaccard_groups(docs.select("doc_id", "text"), k, t), "jaccard-kept")
    first = groups.where("node is not null").groupBy("group").agg(F.min(F.struct("doc_id", "node", "text_key")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"))
    rest = groups.where("node is null and doc_id is not null").select("doc_id", "text_key").distinct()
    keep = written(chosen.unionByName(rest.toDF("_id", "_key")), "jaccard-chosen")
    out = docs.join(keep, (docs["doc_id"] == keep["_id"]) & (F.xxhash64(docs["text"]) == keep["_key"]), "left_semi")
    if not groups.groupBy("doc_id", "text_key").count().where("doc_id is not null and count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id is null"))
