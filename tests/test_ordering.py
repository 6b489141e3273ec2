import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ordering as O

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def rows(spark):
    rng = random.Random(2)
    out = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)])) for k in range(700)]
    return spark.createDataFrame(out, "id long, kind string, x long")


def first_null(v):
    return (v is not None, v)


def test_ranks_equal_sorting(spark, rows):
    data = [tuple(r) for r in rows.collect()]
    got = {r.id: r.pos for r in O.ranked(rows, F.col("x"), F.desc("id")).collect()}
    want = sorted(data, key=lambda r: (first_null(r[2]), -r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 701))
    got = {r.id: r.pos for r in O.ranked(rows, F.desc("x"), F.col("id"), within=("kind",)).collect()}
    for kind in ("hot", "b", None):
        own = sorted((r for r in data if r[1] == kind), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_ranks_of_ties_nothing_and_clashing_names(spark, rows):
    same = spark.createDataFrame([(1, "a", 5, 0)] * 50, "pos long, _part string, _row long, _ROW_ long")
    got = O.ranked(same, F.col("_row"))
    assert sorted(r.pos for r in got.collect()) == list(range(1, 51)) and sorted(got.columns) == sorted(same.columns)
    assert O.ranked(rows.limit(0), F.col("x")).count() == 0
    assert O.ranked(rows.limit(0), F.col("x"), within=("kind",)).count() == 0


def test_no_task_has_the_whole_order(spark, rows):
    for kinds in ((), ("kind",)):
        plan = O.ranked(rows, F.col("x"), within=kinds)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan


def test_pages_follow_cursors(spark, rows):
    keys = [("x", True), ("id", False)]
    order = F.desc("x"), F.col("id")
    want = [r.id for r in rows.orderBy(*order).collect()]
    seen, cursor = [], None
    while page := O.page_after(rows, keys, cursor, 97).collect():
        seen += [r.id for r in page]
        cursor = {"x": page[-1].x, "id": page[-1].id}
    assert seen == want
    index = sorted(O.page_index(O.ranked(rows, *order), ["id"], 97).collect())
    assert [(r.page, r.rows, r.first.id, r.last.id) for r in index] == [(k, len(p), p[0], p[-1]) for k, p in enumerate([want[i : i + 97] for i in range(0, 700, 97)])]
    up = [("x", False), ("id", True)]
    first = O.page_after(rows, up, None, 3).collect()
    assert all(r.x is None for r in first)
    assert [r.id for r in O.page_after(rows, up, {"x": None, "id": first[-1].id}, 1).collect()] == [r.id for r in rows.orderBy("x", F.desc("id")).collect()][3:4]


def test_as_of_takes_the_last_before(spark):
    rng = random.Random(4)
    left = [(k, rng.choice(["h", "h", "h", "q", "none", None]), rng.choice([None, *range(0, 300)])) for k in range(400)]
    right = [(rng.choice(["h", "h", "q", None]), rng.choice([None, *range(0, 300, 3)]), rng.randrange(9)) for _ in range(300)]
    lt = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k string, at timestamp")
    rt = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, r timestamp, l long")
    got = {r.id: r.found for r in O.as_of(lt, rt, "k", "at", "r").collect()}
    assert len(got) == 400
    for i, k, t in left:
        best = max(((u, v) for c, u, v in right if c == k and k is not None and None not in (u, t) and u <= t), default=None)
        assert (got[i] and (got[i].r, got[i].l)) == (best and (at(best[0]), best[1]))
    assert O.as_of(lt, rt.limit(0), "k", "at", "r").where("found is null").count() == 400
    assert O.as_of(lt.limit(0), rt, "k", "at", "r").count() == 0
    assert O.as_of(lt.union(lt), rt, "k", "at", "r").count() == 800


def plain_sessions(data, gap):
    out, open_ = [], {}
    for k, t in sorted((r for r in data if r[1] is not None), key=lambda r: r[1]):
        s = open_.get(k)
        if s and t - s[1] <= gap:
            s[1], s[2] = t, s[2] + 1
        else:
            open_[k] = s = [t, t, 1]
            out.append((k, s))
    return sorted(((k, at(s[0]), at(s[1]), s[2]) for k, s in out), key=str)


def test_sessions_equal_gaps_and_islands(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(0, 4000, 5)])) for _ in range(500)]
    df = spark.createDataFrame([(k, at(t)) for k, t in data], "user string, ts timestamp")
    got = sorted((tuple(r) for r in O.sessions(df, "user", "ts", 60).collect()), key=str)
    assert got == plain_sessions(data, 60) and max(r[3] for r in got) > 20
    assert O.sessions(df.limit(0), "user", "ts", 30).count() == 0
