import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.functions import tables as U
from tidewright.functions import text as T
from tidewright.operators import grouping as G
from tidewright.operators import intervals as I
from tidewright.operators import ordering as O

T0 = dt.datetime(2024, 1, 1)


def some_spans(rng, n):
    out = []
    for k in range(n):
        a = rng.choice([None, *range(-500, 500, 3)])
        size = rng.choice([-5, 0, 1, 2, 7, 8, 9, 64, 300, 1 << 40])
        out.append((k, rng.choice(["h", "h", "x", None]), a, None if a is None or rng.random() < 0.05 else a + size))
    return out


SPAN = "id long, k string, a long, b long"


def test_points_meet_each_span_that_holds_them_once(spark):
    rng = random.Random(1)
    spans = some_spans(rng, 120)
    points = [(k, rng.choice(["h", "h", "x", None]), rng.choice([None, *range(-520, 520)])) for k in range(150)]
    p, s = spark.createDataFrame(points + points[:9], "id long, k string, t long"), spark.createDataFrame(spans, SPAN)
    got = Counter((r.point.id, r.span.id) for r in I.points_in_spans(p, s, "t", "a", "b").collect())
    held = lambda t, a, b: None not in (t, a, b) and a <= t < b
    assert got == Counter((i, j) for i, _, t in points + points[:9] for j, _, a, b in spans if held(t, a, b))
    got = Counter((r.point.id, r.span.id) for r in I.points_in_spans(p, s, "t", "a", "b", on=(("k", "k"),)).collect())
    assert got == Counter((i, j) for i, k, t in points + points[:9] for j, c, a, b in spans if k is not None and k == c and held(t, a, b))
    assert I.points_in_spans(p, s.limit(0), "t", "a", "b").count() == 0 and I.points_in_spans(p.limit(0), s, "t", "a", "b").count() == 0


def test_spans_that_overlap_meet_once(spark):
    rng = random.Random(2)
    left, right = some_spans(rng, 90), some_spans(rng, 90)
    l, r = spark.createDataFrame(left + left[:5], SPAN), spark.createDataFrame(right, SPAN)
    good = lambda a, b: None not in (a, b) and a < b
    for on in ((), ("k",)):
        got = Counter((x.left.id, x.right.id) for x in I.overlapping(l, r, "a", "b", on).collect())
        assert got == Counter((i, j) for i, k, a, b in left + left[:5] for j, c, s, e in right if good(a, b) and good(s, e) and a < e and s < b and (not on or k is not None and k == c))
    assert I.overlapping(l.limit(0), r, "a", "b").count() == 0


def test_moving_sums_equal_range_frames(spark):
    rng = random.Random(3)
    data = [(k, rng.choice(["hot", "hot", "hot", "x", None]), rng.choice([None, *range(0, 400, 4)]), rng.choice([None, *range(-5, 9)])) for k in range(500)]
    df = spark.createDataFrame([(i, k, None if t is None else T0 + dt.timedelta(seconds=t), v) for i, k, t, v in data], "id long, k string, ts timestamp, v long")
    got = {r.id: (r.total, r._o) for r in O.moving_sums(df.withColumn("_o", F.lit(1)), "k", "ts", 60, total="v").collect()}
    assert len(got) == 500
    for i, k, t, _ in data:
        want = None if t is None else sum(v or 0 for _, c, u, v in data if c == k and u is not None and t - 60 <= u <= t)
        assert got[i] == (want, 1)
    assert O.moving_sums(df.limit(0), "k", "ts", 60, total="v").count() == 0


@pytest.mark.parametrize("rows", [0, 200])
def test_sets_of_dimensions_equal_sparks(spark, rows):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6])) for _ in range(rows)], "x string, y int, u int, v long")
    got = G.grouped(df, ["x", "y"], G.cube_sets(["x", "y"]), "u", total="v")
    want = df.cube("x", "y").agg(F.grouping_id().cast("long").alias("grouping_id"), F.count_distinct("u").alias("distinct_u"), F.sum("v").alias("total"))
    columns = ["grouping_id", "x", "y", "distinct_u", "total"]
    show = lambda d: sorted((tuple(r) for r in d.select(*columns).collect()), key=str)
    # Spark's own cube has no row for the empty set of an empty table.
    assert show(got) == (show(want) if rows else [(3, None, None, 0, None)])
    assert len(show(got)) == (16 if rows else 1)
    assert G.rollup_sets(["x", "y"]) == [("x", "y"), ("x",), ()]


def test_sketches_merge_to_what_they_estimate(spark):
    rng = random.Random(5)
    data = [(k % 10, rng.randrange(3000) if k % 50 else None, rng.randrange(10_000) if k % 70 else None) for k in range(30_000)]
    df = spark.createDataFrame(data, "day long, u long, v long")
    kept = G.sketches(df, [F.col("day")], "u", "v")
    one = G.merged_sketches(kept, (F.col("day") % 2).alias("odd")).select("odd", "rows", F.hll_sketch_estimate("distinct_sketch").alias("n"), F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(0.9)).alias("q"))
    for r in one.collect():
        own = [x for x in data if x[0] % 2 == r.odd]
        values = sorted(x[2] for x in own if x[2] is not None)
        assert r.rows == len(own) and abs(r.n / len({x[1] for x in own if x[1] is not None}) - 1) < 0.06
        assert abs(sum(v <= r.q for v in values) / len(values) - 0.9) < 0.03
    counts = Counter(x[1] for x in data if x[1] is not None)
    cells = G.count_min(df, [F.col("day")], "u").groupBy("r", "c").agg(F.sum("n").alias("n")).withColumn("g", F.lit(0))
    asked = df.select("u").distinct().where("u is not null").withColumn("g", F.lit(0))
    guess = {r.u: r.estimate for r in G.estimated(cells, ["g"], asked, "u").collect()}
    assert all(guess[u] >= n for u, n in counts.items()) and sum(guess[u] - n > 2 * 30_000 / G.COLUMNS for u, n in counts.items()) < 0.05 * len(counts)
    assert G.sketches(df.limit(0), [F.col("day")], "u", "v").count() == 0 and G.count_min(df.limit(0), [F.col("day")], "u").count() == 0


def test_folding_finds_and_groups_spellings(spark):
    words = ["jó", "JO", "jó", "Jö", "ja", None, "", "ÇA", "straße", "øre"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = [r[0] for r in df.select(T.folded(F.col("w"))).collect()]
    assert keys == ["jo", "jo", "jo", "jo", "ja", None, "", "ca", "straße", "øre"]
    assert [r.w for r in df.where(T.found_folded(F.col("w"), "Jó")).collect()] == words[:4]
    assert df.where("w is not null").select(T.in_language_order(F.col("w")).alias("w")).groupBy("w").count().where("count = 4").count() == 1
    assert df.limit(0).select(T.folded(F.col("w"))).count() == 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_streaks_over_batches(spark, batch):
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice(["x", "x", "y", None]), k) for k in range(120)]
    want = []
    for key in ("a", "b", None):
        for k, v, place in data:
            if k == key:
                if want and want[-1][0] == k and want[-1][1] == v and want[-1][5] is key:
                    want[-1][3], want[-1][4] = place, want[-1][4] + 1
                else:
                    want.append([k, v, place, place, 1, key])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(data, "k string, v string, n long")
        assert sorted((tuple(r) for r in U.streaks(df, "k", "v", "n").collect()), key=str) == sorted((tuple(w[:5]) for w in want), key=str)
        assert U.streaks(df.limit(0), "k", "v", "n").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("per_bin", [8, 60, 1 << 16])
def test_overlap_totals_equal_sums_over_pairs(spark, monkeypatch, per_bin):
    monkeypatch.setattr(I, "PER_BIN", per_bin)
    rng = random.Random(per_bin)
    left, right = some_spans(rng, 90), some_spans(rng, 150)
    want = {}
    for i, _, a, b in left + left[:5]:
        for j, _, s, e in right:
            if None not in (a, b, s, e) and a < b and s < e and a < e and s < b:
                n, least, shared = want.get(i, (0, j, 0))
                want[i] = (n + 1, min(least, j), shared + min(b, e) - max(a, s))
    l, r = spark.createDataFrame(left + left[:5], SPAN), spark.createDataFrame(right, SPAN)
    got = {x.id: (x.n, x.least, x.shared) for x in I.overlap_totals(l, r, "a", "b", "id", "id").collect()}
    assert got == want
    assert I.overlap_totals(l.limit(0), r, "a", "b", "id", "id").count() == 0 and I.overlap_totals(l, r.limit(0), "a", "b", "id", "id").count() == 0
