"""Centroid clustering of integer vectors by Shallot search: Lloyd's rounds that skip most distances.

Each vector keeps its nearest centroid with an upper bound of the distance, its second-nearest one, and a
lower bound of the distance to any but the nearest. When centroids move, the bounds are loosened by how
far they moved. A vector whose upper bound is below the lower one, or below half the way from its
centroid to the next, stays where it is. Any other is measured against both remembered centroids and the
search starts from the closer of them: the other centroids are visited in the order of their distance
from the start s, and one further from s than d(x, s) + d(x, second-best so far) ends it; this ball
shrinks whenever a closer second is found. Bounds are doubles, rounded outwards, and only ever turn down
centroids that are strictly further away; what survives them is compared in exact integers, ties going to
the smaller number. So the result is that of comparing everything.

Vectors are rows of a table that each round rewrites with its bounds, without a shuffle: points are
integers, which Parquet keeps in about a byte a component where they are small. Tasks sum their own
vectors by centroid, and only (partitions x centroids) sums are shuffled. The driver holds the centroids:
k x dimensions numbers, and nothing that grows with the vectors.

Defined results: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite, also
not 64-fold; others have no row. Repeated ids are rows of their own, a null id is kept and never starts a
cluster. Starting centroids are the kept rows with the smallest hash of the id, ties by vector; with fewer
rows than centroids there are as many centroids as rows that have an id. Centroids left empty stay. Vectors
equally near to two centroids go to the smaller number. A distance or inertia beyond 64 bits is null.
Further columns are dropped. An empty table, or one without kept vectors that have an id, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.sources.tables import table

#: Scale of the components.
SCALE = 64
#: Below this, squared distances of a few dimensions fit 64 bits; larger components are compared as Python's integers.
SMALL = 1 << 26
#: Outward rounding of bounds, above any error of their few operations.
SLACK = 1e-12
_STATE = "point array<double>, near int, second int, upper double, lower double, distance string"


def integers(rows: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python's where they are large."""
    if not rows.size or np.abs(rows).max() < SMALL:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Bounds:
    """What is known of some vectors: numbers of the nearest and second-nearest centroid, and bounds."""

    near: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))


class Centroids:
    """Centroids with, for each, the others in the order of their distance from it."""

    def __init__(self, rows: list[list[int]]):
        self.rows, k = rows, len(rows)
        self.exact = integers(np.array(rows, object)) if max((abs(x) for r in rows for x in r), default=0) >= SMALL else np.array(rows, np.int64)
        gaps = np.array([root(squared(self.exact, c)) for c in self.exact]).reshape(k, k) * (1 - SLACK)
        np.fill_diagonal(gaps, -1)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.half = self.gaps[:, 0] / 2 * (1 - SLACK) if k > 1 else np.full(k, np.inf)

    def moved(self, before: Centroids, b: Bounds) -> None:
        """Loosens bounds that hold for the centroids ``before``."""
        way = root(squared(self.exact, before.exact)) * (1 + SLACK)
        b.upper[:] = (b.upper + way[b.near]) * (1 + SLACK)
        if len(way) > 1:
            first, next_ = np.sort(way)[::-1][:2]
            b.lower[:] = np.maximum(0, (b.lower - np.where(b.near == way.argmax(), next_, first)) * (1 - SLACK))

    def assign(self, points: np.ndarray, b: Bounds) -> int:
        """Brings ``b`` to the nearest centroids; returns how many distances were computed."""

        def unsure(i: np.ndarray) -> np.ndarray:
            return i[~(b.upper[i] < np.maximum(b.lower[i], self.half[b.near[i]]))]

        i = unsure(np.arange(len(points)))
        b.upper[i] = root(squared(points[i], self.exact[b.near[i]])) * (1 + SLACK)
        done, i = len(i), unsure(i)
        if len(self.rows) == 1:
            return done
        one, two = (squared(points[i], self.exact[c[i]]) for c in (b.near, b.second))
        done += len(i)
        start = np.where(two < one, b.second[i], b.near[i])
        for s in np.unique(start):
            at = np.flatnonzero(start == s)
            done += self._scan(int(s), i[at], points[i[at]], one[at], two[at], b)
        return done

    def _scan(self, s: int, rows: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray, b: Bounds) -> int:
        """Searches the ball around centroid s for the vectors ``x``, whose remembered distances are one and two."""
        n1, n2, reach, done = b.near[rows], b.second[rows], root(np.minimum(one, two)) * (1 + SLACK), 0
        seen = n1.copy(), n2.copy()
        turn = (two < one) | ((two == one) & (n2 < n1))
        d1, d2 = np.where(turn, two, one), np.where(turn, one, two)
        n1, n2 = np.where(turn, n2, n1), np.where(turn, n1, n2)
        live = np.arange(len(rows))
        for c, gap in zip(self.order[s], self.gaps[s], strict=True):
            live = live[gap <= (reach[live] + root(d2[live])) * (1 + SLACK)]
            if not len(live):
                break
            new = live[(seen[0][live] != c) & (seen[1][live] != c)]
            d = squared(x[new], self.exact[c])
            done += len(new)
            first = (d < d1[new]) | ((d == d1[new]) & (c < n1[new]))
            then = ~first & ((d < d2[new]) | ((d == d2[new]) & (c < n2[new])))
            at = new[first]
            d2[at], n2[at], d1[at], n1[at] = d1[at], n1[at], d[first], c
            at = new[then]
            d2[at], n2[at] = d[then], c
        b.near[rows], b.second[rows] = n1, n2
        b.upper[rows], b.lower[rows] = root(d1) * (1 + SLACK), root(d2) * (1 - SLACK)
        return done


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _assigned(rows: DataFrame, key: str, dims: int, now: Centroids, before: Centroids | None, last: bool) -> DataFrame:
    """``rows`` (key and vector, or a state) assigned to the centroids ``now``; the last time with their distances."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if before is None:
                whole = np.floor(_matrix(batch.column(1), dims) * SCALE)
                b = Bounds.unknown(len(whole), len(now.rows))
            else:
                whole = _matrix(batch.column(1), dims)
                b = Bounds(*(np.array(batch.column(k)) for k in range(2, 6)))
                now.moved(before, b)
            points = integers(whole)
            now.assign(points, b)
            far = [str(x) for x in squared(points, now.exact[b.near])] if last else [None] * len(whole)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, whole.size + 1, dims), pa.int32()), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *map(pa.array, (b.near, b.second, b.upper, b.lower)), pa.array(far, pa.string())], names=[key, "point", "near", "second", "upper", "lower", "distance"])

    return rows.mapInArrow(run, f"`{key}` {kind}, {_STATE}")


def _means(state: DataFrame, dims: int, old: Centroids) -> Centroids:
    """Each centroid moved to the floor of its vectors' mean; an empty one stays."""
    k = len(old.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            points, near = integers(_matrix(batch.column(1), dims)), np.array(batch.column(0))
            for c in np.unique(near):
                own = points[near == c]
                counts[c] += len(own)
                sums[c] = [a + int(x) for a, x in zip(sums[c], own.sum(axis=0), strict=True)]
        used = [c for c in range(k) if counts[c]]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([counts[c] for c in used], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in used], pa.list_(pa.string()))], names=["near", "n", "sums"])

    parts = state.select("near", "point").mapInArrow(run, "near int, n long, sums array<string>")
    rows = parts.select("near", "n", F.posexplode("sums").alias("i", "x")).groupBy("near", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new = [list(r) for r in old.rows]
    for r in rows.collect():  # at most k x dims rows
        new[r.near][r.i] = int(r.x) // r.n
    return Centroids(new)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dims: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of each kept vector after ``rounds`` moves of the centroids, and the centroids.

    ``distance`` is the squared distance as a decimal number in a string, exact at any size.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf"))
    kept = vectors.where((F.size(vector) == dims) & ~F.exists(vector, bad)).select(key, vector)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    seeds = kept.where(F.col(key).isNotNull()).orderBy(first, vector).limit(k).collect()
    if not seeds:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {vectors.schema[key].dataType.simpleString()}, cluster int, distance string"), []
    now, before, state = Centroids([[int(np.floor(float(x) * SCALE)) for x in r[1]] for r in seeds]), None, kept
    for r in range(rounds + 1):
        state = written(_assigned(state, key, dims, now, before, r == rounds), "clusters")
        if r < rounds:
            now, before = _means(state, dims, now), now
    return state.select(key, F.col("near").alias("cluster"), "distance"), now.rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components, with inertias and a digest of each centroid."""
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    exact = rows.withColumn("d", F.col("distance").cast("decimal(38,0)"))
    sums = exact.groupBy("cluster").agg(F.sum("d").alias("sum"))
    total = sums.agg(F.sum("sum").alias("all"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    # A row for each centroid at most, so these are small at any size.
    of = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sums, "cluster").crossJoin(total)
    long = lambda c: F.col(c).try_cast("long")
    return exact.join(F.broadcast(of), "cluster").select("vec_id", "cluster", long("d").alias("distance"), long("sum").alias("cluster_inertia"), long("all").alias("inertia"), "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3, seed: str = "1") -> str:
    """The same by comparing every vector with every centroid."""
    steps = [
        "v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "p as materialized (select rid, unnest(e) as x, unnest(range(1, 65)) as i from v)",
        f"k0 as materialized (select c, unnest(e) as x, unnest(range(1, 65)) as i from (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, e from v qualify c < {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as materialized (select rid, c, sum((p.x - k.x) * (p.x - k.x))::bigint as d from p join k{r} k using (i) group by rid, c)")
        steps.append(f"a{r} as materialized (select rid, c, d from d{r} qualify row_number() over (partition by rid order by d, c) = 1)")
        if r < rounds:
            steps.append(f"s{r} as (select c, i, sum(x)::bigint as s, count(*) as n from a{r} join p using (rid) group by c, i)")
            steps.append(f"k{r + 1} as materialized (select k.c, k.i, coalesce((s - ((s % n) + n) % n) // n, k.x) as x from k{r} k left join s{r} using (c, i))")
    steps.append(f"h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from k{rounds} group by c)")
    return "with " + ",\n".join(steps) + (
        f"\nselect vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{rounds} join v using (rid) join h using (c)"
    )


SQL = _sql()
