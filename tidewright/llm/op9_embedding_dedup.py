"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors of equal components are one node. Nodes are dealt into shards by hash, each shard builds
its graph in one task, and every node queries the graph of every shard, in slices of ``SLICE`` queries:
a task reads one shard's graph once and streams a slice through it. A beam search evaluates neighbours
until its beam holds no unexpanded node; all evaluated nodes of cosine ``LEAST`` or more, in double
precision, are links. Where a whole beam is above the threshold, more may lie beyond it, and these
queries are repeated with a beam four times as wide and, where that is not enough either, by a scan of the shard
once that is cheaper.

Each task audits itself: for some of its queries the shard is scanned by brute force, more and more of
them until ``TRUE_LINKS`` links to other nodes have been seen or ``AUDITED`` queries scanned. If fewer than
``RECALL`` of these links were found, the slice is searched again with wider beams, at the end as wide as the
shard. The numbers of links that the audits saw and found are summed over all tasks and returned, and
if together they fall short, all is searched again with wider beams.

A task returns each query's number of links and a spanning forest of the links found, not the
links, so what a dense group gives is linear in its vectors. Components follow by contraction.

Searching every shard makes work in proportion to nodes times shards; a shard takes up to
``PER_SHARD`` nodes, so their number grows slowly.

Defined results
---------------
* vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
  do rows without an id. Vectors of different lengths never link.
* repeated vectors (also rows of one id) count as links of each other: n_links counts other rows. Equal
  vectors are counted, not searched, so a vector that a third of all rows hold costs no more than one.
* ties: the smallest id of a component names it and is kept, in each of its rows if it is repeated.
* a vector may be of any length, in single precision; an empty table gives an empty table; other columns
  are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.graph import components, least_of
from tidewright.llm.shared import written
from tidewright.llm.tokens import blob, mix
from tidewright.sources.tables import table

#: Least cosine; least shards and most nodes of one; queries of a block and of a task.
LEAST, SHARDS, PER_SHARD, QUERIES, SLICE = 0.9, 6, 50_000, 512, 65_536
#: Least slices, so that few nodes are searched by many tasks too, as long as each has ``QUERIES`` of them.
SLICES = 4
#: Cosines that are held at once.
COSINES = 1 << 24
#: Neighbours of a node above the ground level (twice as many on it), beams, nodes expanded at once.
DEGREE, BEAM_BUILD, BEAM, EXPAND = 12, 48, 16, 4
#: A scan of a shard of n nodes costs no more than a beam of n / SCAN, as it gathers no rows; only beams widened before give way to it.
SCAN = 64
#: Queries that a task audits first and at most, links it must see to stop, and the part that must be found.
FIRST, AUDITED, TRUE_LINKS, RECALL = 64, 1024, 200, 0.98


def _scans(wide: int, n: int) -> bool:
    """Whether beams of ``wide`` give way to a scan of n nodes: not before a widened beam has been tried."""
    return wide > 4 * BEAM and wide * SCAN >= n


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in descending order."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1), 1)
    return np.argsort(-sims, axis=1)


class Graph:
    """Levels of nodes (the ground last), each with its nodes' neighbours, -1 for none."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.raw = vectors
        self.x = _unit(vectors)
        self.levels = levels if levels is not None else self._built()

    def _built(self) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.x)
        h = mix(np.arange(1, n + 1, dtype=np.uint64)).astype(np.float64) / 2**64
        height = np.floor(-np.log(np.maximum(h, 1e-18)) / np.log(DEGREE)).astype(int)
        self.levels = []
        for level in range(int(height.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(height >= level)
            width = 2 * DEGREE if level == 0 else DEGREE
            near = np.full((len(nodes), width), -1, np.int64)  # places in nodes
            entry = self._entries(self.x[nodes]) if self.levels else None
            self.levels.append((nodes, near))
            done = min(len(nodes), 64)
            self._link(nodes, near, np.arange(done), None, width)
            while done < len(nodes):
                new = np.arange(done, min(len(nodes), done + min(done, QUERIES)))
                start = np.searchsorted(nodes, entry[new]) if entry is not None else np.zeros(len(new), np.int64)
                start = np.where(start < done, start, start % done)
                found, sims, _ = self._beam(self.x[nodes[new]], start[:, None], BEAM_BUILD, nodes, near)
                self._link(nodes, near, new, (found, sims), width)
                done += len(new)
        return self.levels

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """The node that each query gets to through all levels built so far."""
        at = np.zeros((len(q), 1), np.int64)
        for k, (nodes, near) in enumerate(self.levels):
            best = np.zeros(len(q), np.int64)
            for i in range(0, len(q), QUERIES):
                found, _, _ = self._beam(q[i : i + QUERIES], at[i : i + QUERIES], 4, nodes, near)
                best[i : i + QUERIES] = found[:, 0]
            here = nodes[best]
            below = self.levels[k + 1][0] if k + 1 < len(self.levels) else None
            at = np.searchsorted(below, here)[:, None] if below is not None else here[:, None]
        return at[:, 0]

    def _beam(self, q: np.ndarray, start: np.ndarray, ef: int, nodes: np.ndarray, near: np.ndarray, least: float = 2.0):
        """Beams of places in ``nodes``, their cosines, and (query, place) of all evaluated at ``least`` or more."""
        b, n = len(q), len(nodes)
        ef = min(ef, n)
        seen = np.zeros((b, n + 1), bool)
        rows = np.arange(b)[:, None]
        seen[:, n] = True
        seen[rows, start] = True
        ids = np.full((b, ef), n, np.int64)
        sims = np.full((b, ef), -2.0, np.float32)
        ids[:, :1] = start
        sims[:, 0] = np.einsum("bd,bd->b", self.x[nodes[start[:, 0]]], q)
        open_ = np.zeros((b, ef), bool)
        open_[:, 0] = True
        hits = [np.stack([np.flatnonzero(sims[:, 0] >= least), start[sims[:, 0] >= least, 0]])]
        while open_.any():
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :EXPAND]
            ok = np.take_along_axis(open_, pick, 1)
            np.put_along_axis(open_, pick, False, 1)
            at = np.where(ok, np.take_along_axis(ids, pick, 1), n)
            more = np.where(at[:, :, None] < n, near[np.minimum(at, n - 1)], -1).reshape(b, -1)
            more = np.where(more < 0, n, more)
            more = np.where(seen[rows, more], n, more)
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = n
            keep = (more < n).any(axis=0)
            if not keep.any():
                continue
            more = more[:, keep]
            seen[rows, more] = True
            fresh = (self.x[nodes[np.minimum(more, n - 1)]] @ q[:, :, None])[:, :, 0]
            fresh[more == n] = -2.0
            if least < 2:
                i, j = np.nonzero(fresh >= least)
                hits.append(np.stack([i, more[i, j]]))
            every, cos = np.concatenate([ids, more], 1), np.concatenate([sims, fresh], 1)
            unopened = np.concatenate([open_, more < n], 1)
            top = _top(cos, ef)
            ids, sims, open_ = (np.take_along_axis(a, top, 1) for a in (every, cos, unopened))
        return ids, sims, np.concatenate(hits, axis=1)

    def _chosen(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, nodes: np.ndarray, width: int) -> np.ndarray:
        """Neighbours of each of ``own``: near ones first, left out if nearer to one chosen before; then the nearest left."""
        n = len(nodes)
        order = _top(sims, sims.shape[1])
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        good = (sims > -2) & (ids != own[:, None])
        good[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        vec = self.x[nodes[np.minimum(np.maximum(ids, 0), n - 1)]]
        between = vec @ vec.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            nearer = (taken[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
            taken[:, j] = good[:, j] & ~nearer & (taken[:, :j].sum(axis=1) < width)
        rank = np.where(taken, 0, np.where(good, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _link(self, nodes, near, new, found, width):
        """Links of new nodes to what they found and to each other, and back."""
        x = self.x[nodes[new]]
        among = x @ x.T
        np.fill_diagonal(among, -2.0)
        top = _top(among, min(len(new), width))
        ids, sims = new[top], np.take_along_axis(among, top, 1)
        if found is not None:
            ids, sims = np.concatenate([found[0], ids], 1), np.concatenate([found[1], sims], 1)
        near[new] = self._chosen(new, ids, sims, nodes, width)
        src, dst = np.repeat(new, width), near[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        into, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = 2 * width  # of many that point to one node, the nearest are looked at
        for i in range(0, len(into), QUERIES):
            own, f, m = into[i : i + QUERIES], first[i : i + QUERIES], count[i : i + QUERIES]
            at = np.arange(min(int(m.max()), most))
            extra = np.where(at < m[:, None], src[np.minimum(f[:, None] + at, len(src) - 1)], -1)
            for k in np.flatnonzero(m > most):
                who = src[f[k] : f[k] + m[k]]
                extra[k] = who[np.argsort(-(self.x[nodes[who]] @ self.x[nodes[own[k]]]))[:most]]
            ids = np.sort(np.concatenate([near[own], extra], 1), axis=1)
            sims = np.einsum("bmd,bd->bm", self.x[nodes[np.maximum(ids, 0)]], self.x[nodes[own]])
            sims[ids < 0] = -2.0
            sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.0
            near[own] = self._chosen(own, ids, sims, nodes, width)

    def links(self, raw: np.ndarray, ef: int, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the links found for a block of queries with beams of ``ef`` or wider."""
        q = _unit(raw)
        ground, near = self.levels[-1]
        n, rough = len(ground), least - 1e-4
        entry = self._entries(q)
        parts, todo, wide = [], np.arange(len(q)), ef
        while len(todo):
            again = []
            step = max(1, min(QUERIES, COSINES // (n + 1)))
            for i in range(0, len(todo), step):
                own = todo[i : i + step]
                if _scans(wide, n):
                    hits = np.stack(np.nonzero(q[own] @ self.x.T >= rough))
                    full = np.zeros(len(own), bool)
                else:
                    _, sims, hits = self._beam(q[own], entry[own][:, None], wide, ground, near, rough)
                    full = sims[:, -1] >= rough
                again.append(own[full])
                i_, j_ = hits[:, ~full[hits[0]]]
                parts.append(self._exact(raw, own[i_], j_, least))
            todo, wide = np.concatenate(again), wide * 4
        i, j = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
        return i, j

    def _exact(self, raw: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Those pairs of a query and a node that reach the threshold in double precision."""
        keep = []
        for k in range(0, len(i), 1 << 16):
            a, b = raw[i[k : k + (1 << 16)]].astype(np.float64), self.raw[j[k : k + (1 << 16)]].astype(np.float64)
            keep.append(np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= least)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return np.stack([i[keep], j[keep]])


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, first node of its group) that connect what a - b does."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _built(group: pa.Table) -> pa.Table:
    """A shard's index as one row."""
    x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(len(group), -1)
    g = Graph(x)
    first = lambda c: group.column(c)[0].as_py()
    return pa.table(
        {
            "dim": pa.array([first("dim")], pa.int32()), "shard": pa.array([first("shard")], pa.int32()),
            "nodes": pa.array([blob(group.column("node").to_numpy())], pa.binary()),
            "copies": pa.array([blob(group.column("copies").to_numpy())], pa.binary()),
            "vectors": pa.array([blob(x)], pa.binary()),
            "levels": pa.array([[blob(a.astype(np.int32)) for level in g.levels for a in level]], pa.list_(pa.binary())),
        }
    )


def _audit(g: Graph, x: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> list[tuple[int, set[int]]]:
    """For some of the queries ``x`` (nodes ``own``) the places of all their links to other nodes, by scanning the shard."""
    order, out, seen = np.argsort(mix(own.astype(np.uint64)), kind="stable")[:AUDITED], [], 0
    at, step = 0, FIRST
    while at < len(order) and (not out or seen < TRUE_LINKS):
        some = order[at : at + step]
        block = max(1, COSINES // len(g.x))
        near = [np.stack(np.nonzero(_unit(x[some[k : k + block]]) @ g.x.T >= LEAST - 1e-4)) + [[k], [0]] for k in range(0, len(some), block)]
        i, j = np.concatenate(near, axis=1)
        i, j = g._exact(x, some[i], j, LEAST)
        other = nodes[j] != own[i]
        i, j = i[other], j[other]
        out += [(int(k), set(j[i == k].tolist())) for k in some]
        seen, at, step = seen + len(i), at + step, step * 2
    return out


def _searched(ef: int):
    """Of some queries in one shard: numbers of links (row = 1), a forest of the links (row = 0), and
    links that the audit saw and found (row = 2)."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        rows = [np.zeros((3, 0), np.int64)]
        if len(queries) and len(index):
            get = lambda c, kind: np.frombuffer(index.column(c)[0].as_py(), kind)
            nodes, copies = get("nodes", np.int64), get("copies", np.int64)
            dim = index.column("dim")[0].as_py()
            flat = [np.frombuffer(v, np.int32) for v in index.column("levels")[0].as_py()]
            levels = [(x, y.reshape(len(x), -1)) for x, y in zip(flat[::2], flat[1::2], strict=True)]
            g = Graph(get("vectors", np.float32).reshape(-1, dim), levels)
            own = queries.column("node").to_numpy()
            x = np.frombuffer(b"".join(queries.column("vector").to_pylist()), np.float32).reshape(-1, dim)
            truth, wide = _audit(g, x, own, nodes), ef
            true = sum(len(t) for _, t in truth)
            while True:
                found, audited = [], {k: 0 for k, _ in truth}
                for i in range(0, len(own), QUERIES):
                    mine = own[i : i + QUERIES]
                    q, v = g.links(x[i : i + QUERIES], wide)
                    other = nodes[v] != mine[q]  # copies of the query itself are known
                    q, v = q[other], v[other]
                    n = np.bincount(q, weights=copies[v], minlength=len(mine)).astype(np.int64)
                    pairs = np.bincount(q, minlength=len(mine))
                    audited |= {k: int(pairs[k - i]) for k in audited if i <= k < i + len(mine)}
                    e, f = forest(mine[q], nodes[v])
                    found += [np.stack([mine, n, np.ones_like(n)]), np.stack([e, f, np.zeros_like(e)])[:, e != f]]
                if sum(audited.values()) >= RECALL * true or _scans(wide, len(nodes)):
                    break
                wide *= 4
            rows += [*found, np.array([[true], [sum(audited.values())], [2]])]
        a, b, kind = np.concatenate(rows, axis=1)
        return pa.table({"a": a, "b": b, "row": pa.array(kind.astype(np.int32))})

    return run


def near_embeddings(vectors: DataFrame, least_shards: int = SHARDS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept; and the same in all rows,
    audited_links and audited_recall: links that the audits saw, and the part of them that was found (null: none seen)."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    key = F.when(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64(e), F.xxhash64(e, F.lit(1))))
    rows = rows.withColumn("key", key)

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.asarray(x, np.float32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(v, pa.binary())], names=["node", "copies", "vector"])

    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    # Rows of one id may hold different vectors, so a vector's node has a number of its own, which the written table fixes.
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")
    nodes = written(
        groups.select("node", "copies", "embedding").mapInArrow(as_bytes, "node long, copies long, vector binary").withColumn("dim", F.expr("cast(length(vector) / 4 as int)")), "vectors-nodes"
    )
    n = nodes.count()
    shards, slices = max(least_shards, -(-n // PER_SHARD)), max(1, min(SLICES, n // QUERIES), -(-n // SLICE))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("dim", "shard").applyInArrow(_built, "dim int, shard int, nodes binary, copies binary, vectors binary, levels array<binary>"), "vectors-index")
    asked = nodes.withColumn("task", F.pmod(F.xxhash64("vector", F.lit(2)), F.lit(slices)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "task", "node", "vector")
    spread = index.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys, ef = ("dim", "shard", "task"), BEAM
    while True:
        found = written(asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_searched(ef), "a long, b long, row int"), "vectors-found")
        true, seen = found.where("row = 2").agg(F.sum("a"), F.sum("b")).first()
        if not true or seen >= RECALL * true or _scans(ef, n):
            break
        ef *= 4
    counts = found.where("row = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    roots = written(components(found.where("row = 0").select("a", "b")), "vectors-roots")
    least = least_of(roots, groups.select("node", F.col("least_id").alias("value"))).withColumnRenamed("least", "component_id")
    by_node = groups.select("key", "node", "least_id", "copies").join(counts, "node", "left").join(least, "node", "left")
    by_node = by_node.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.select("vec_id", "key").join(by_node, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(true or 0).cast("long").alias("audited_links"),
        F.lit(seen / true if true else None).cast("double").alias("audited_recall"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links and groups."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))
