import hashlib
import random

import numpy as np

from tidewright.llm import op11_clustering as op11


def plain(points, k, rounds, ids, seed="1"):
    """Lloyd's rounds over Python's integers, every vector against every centroid."""
    first = sorted((i for i in range(len(points)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), points[i]))[:k]
    cs = [list(points[i]) for i in first]
    nearest = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        of = [nearest(p)[1] for p in points]
        for c in range(len(cs)):
            own = [p for p, n in zip(points, of, strict=True) if n == c]
            if own:
                cs[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [nearest(p) for p in points], cs


def test_search_equals_comparing_all_and_skips_most():
    rng = np.random.default_rng(3)
    for spread, k in ((1, 12), (6, 12), (200, 40), (1 << 40, 5)):
        middle = rng.integers(-50 * spread, 50 * spread + 1, (k, 8))
        points = middle[rng.integers(0, k, 3000)] + rng.integers(-spread, spread + 1, (3000, 8))
        points = op11.integers(points.astype(float))
        rows = [[int(x) for x in r] for r in points[:k]]
        before, bounds, done = None, op11.Bounds.unknown(len(points), k), 0
        for _ in range(5):
            now = op11.Centroids(rows)
            if before:
                now.moved(before, bounds)
            done += now.assign(points, bounds)
            every = np.array([op11.squared(points, c) for c in now.exact])
            assert (bounds.near == every.argmin(axis=0)).all()  # the first of equals
            at = np.arange(len(points))
            assert (bounds.upper >= op11.root(every[bounds.near, at])).all()
            others = np.where(np.arange(k)[:, None] == bounds.near, np.inf, every.astype(float))
            assert (bounds.lower <= np.sqrt(others.min(axis=0))).all()
            before = now
            rows = [[int(x) for x in points[bounds.near == c].sum(axis=0) // (bounds.near == c).sum()] if (bounds.near == c).any() else rows[c] for c in range(k)]
        assert done < 5 * 3000 * k / 2


def test_rows_equal_plain_rounds(spark):
    rng = random.Random(4)
    vectors = [[rng.choice([-0.5, -0.01, 0.0, 0.3, 1.0]) for _ in range(4)] for _ in range(120)]
    ids = [k if k % 7 else None for k in range(110)] + list(range(10))  # null and repeated ids
    bad = [(1, None, 0), (2, [], 0), (3, [1.0, None, 0.0, 0.0], 0), (4, [1.0, float("nan"), 0.0, 0.0], 0), (5, [1.0, float("inf"), 0.0, 0.0], 0), (6, [1.0] * 5, 0), (7, [1e307] * 4, 0)]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors, strict=True)] + bad, "vec_id long, embedding array<double>, cluster int")
    points = [[int(np.floor(64 * x)) for x in v] for v in vectors]
    for k in (1, 2, 9, 200):
        got, centroids = op11.clustered(df, k=k, rounds=3, dims=4)
        want, cs = plain(points, k, 3, ids)
        assert centroids == cs
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, c, str(d)) for i, (d, c) in zip(ids, want, strict=True)), key=key)


def test_large_components_and_no_rows(spark):
    df = spark.createDataFrame([(k, [x, 0.0]) for k, x in enumerate([1e15, 1e15 + 1, -3e18, 5.0])], "vec_id long, embedding array<double>")
    got, centroids = op11.clustered(df, k=2, rounds=2, dims=2)
    points = [[64 * int(x), 0] for x in (1e15, 1e15 + 1, -3e18, 5.0)]
    want, cs = plain(points, 2, 2, range(4))
    assert centroids == cs and sorted(tuple(r) for r in got.collect()) == [(k, c, str(d)) for k, (d, c) in enumerate(want)]
    for none in (df.limit(0), df.where("vec_id < 0"), df.selectExpr("cast(null as long) as vec_id", "embedding")):
        rows, centroids = op11.clustered(none, dims=2)
        assert rows.count() == 0 and centroids == []
