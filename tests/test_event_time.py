import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ordering
from tidewright.streaming import event_time as E
from tidewright.streaming import live, replay
from tidewright.streaming.parts import in_parts

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def split(spark, data, schema):
    """The parts of rows whose first field is the part."""
    return [spark.createDataFrame([r for r in data if r[0] == n], schema) for n in range(1 + max(r[0] for r in data))]


def events(rng, n=300, parts=4):
    """Rows (part, user, time), mostly in order, some late, some without time or user."""
    out = []
    for _ in range(n):
        t = rng.randrange(1000 * parts)
        out.append((min(parts - 1, t // 1000 + rng.choice([0, 0, 0, 0, 1, 2])), rng.choice(["hot", "hot", "b", None]), at(t) if rng.random() > 0.05 else None))
    return out


def shown(rows):
    return sorted((tuple(map(str, r)) for r in rows), key=str)


SCHEMA = "part int, user string, ts timestamp"


def test_windows_drop_what_is_too_late_and_hold_what_is_open(spark):
    data = events(random.Random(3))
    parts, table = split(spark, data, SCHEMA), spark.createDataFrame(data, SCHEMA)
    for slide in (None, "100 seconds"):
        args = ("ts", "150 seconds", "300 seconds", ["user"], F.count("*").alias("n"))
        got = in_parts(parts, lambda s, a=args, w=slide: E.windows(s, *a, slide=w)).select("window", "user", "n").collect()
        assert shown(got) == shown(E.windows_of_parts(table, *args, slide=slide).select("window", "user", "n").collect())
        marks = {0: None, 1: 1000, 2: 2000, 3: 3000}
        ends = {r.window.end for r in got}
        assert max(ends) <= max(r[2] for r in data if r[2]) - dt.timedelta(seconds=150) and len(marks) == 4
    every = table.groupBy(F.window("ts", "300 seconds"), "user").count().agg(F.sum("count")).first()[0]
    assert 0 < sum(r.n for r in in_parts(parts, lambda s: E.windows(s, "ts", "150 seconds", "300 seconds", ["user"], F.count("*").alias("n"))).collect()) < every


def test_a_late_row_joins_two_sessions(spark):
    parts = split(spark, [(0, "a", at(0)), (0, "a", at(100)), (0, "b", at(0)), (1, "a", at(50)), (2, "z", at(10_000)), (2, None, None)], SCHEMA)
    got = in_parts(parts, lambda s: E.user_sessions(s, "ts", "200 seconds", "60 seconds", ["user"], F.count("*").alias("n"))).collect()
    assert shown((r.user, r.session_window.start, r.session_window.end, r.n) for r in got) == shown([("a", at(0), at(160), 3), ("b", at(0), at(60), 1)])


def test_sessions_of_a_stream_in_time_are_those_of_a_table(spark):
    data = [r for r in events(random.Random(5)) if r[1] and r[2]]
    parts, table = split(spark, data, SCHEMA), spark.createDataFrame(data, SCHEMA)
    delay = 4000  # nothing is too late
    more = spark.createDataFrame([(9, "end", at(50_000))], SCHEMA)
    got = in_parts([*parts, more], lambda s: E.user_sessions(s, "ts", f"{delay} seconds", "20 seconds", ["user"], F.count("*").alias("n"))).collect()
    want = ordering.sessions(table, "user", "ts", 20).collect()
    assert shown((r.user, r.session_window.start, r.session_window.end - dt.timedelta(seconds=20), r.n) for r in got) == shown((r.user, r.start, r.end, r.rows) for r in want)


def test_each_event_once_however_often_it_comes(spark):
    rng = random.Random(6)
    first = [(p, k, t) for k, (p, _, t) in enumerate(events(rng, 200))]
    data = first + [(min(3, p + 1), k, t) for p, k, t in first if k % 3 == 0] + [(p, k, t) for p, k, t in first if k % 5 == 0]
    schema = "part int, id long, ts timestamp"
    parts, table = split(spark, data, schema), spark.createDataFrame(data, schema)
    got = sorted(r.id for r in in_parts(parts, lambda s: E.distinct_rows(s, "ts", "300 seconds", ["id"]).select("id")).collect())
    want = sorted(r.id for r in E.in_time(table, "ts", "300 seconds", F.col("ts")).select("id").distinct().collect())
    assert got == want and len(want) < len({k for _, k, t in first if t})


def test_no_rows_give_no_windows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert in_parts([none], lambda s: E.windows(s, "ts", "1 second", "5 seconds", ["user"], F.count("*").alias("n"))).count() == 0
    assert E.windows_of_parts(none, "ts", "1 second", "5 seconds", ["user"], F.count("*").alias("n")).count() == 0
    assert E.in_time(none, "ts", "1 second", F.col("ts")).count() == 0


def changes(rng, n=400):
    versions, out = {}, []
    for _ in range(n):
        key = rng.choice(["hot", "hot", "hot", "x", None]), rng.choice(["u", "v", "w", None])
        versions[key] = versions.get(key, 0) + 1
        out.append((rng.randrange(4), *key, versions[key], rng.choice(["toggle", "toggle", "add", "remove", "odd"])))
    return out + out[:50]  # some come twice


def test_changes_out_of_order_lose_nothing(spark):
    data = changes(random.Random(7))
    want = {}
    for _, name, who, v, op in sorted(data, key=lambda r: r[3]):
        state = want.get((name, who), (0, False))
        if v == state[0] + 1:
            want[name, who] = v, replay.applied(state[1], op)
    schema = "part int, list string, member string, version long, op string"
    table = spark.createDataFrame(data, schema)
    assert {(r["list"], r.member): (r.version, r.present) for r in replay.replayed(table).collect()} == want
    got = in_parts(split(spark, data, schema), replay.replay_stream, "update")
    last = got.groupBy("list", "member").agg(F.max_by(F.struct("version", "present"), "version").alias("s")).collect()
    assert {(r["list"], r.member): tuple(r.s) for r in last} == want
    whole = {r["list"]: r.members for r in replay.lists(got).collect()}
    assert whole == {r["list"]: r.members for r in replay.lists(replay.replayed(table)).collect()} and "hot" in whole
    assert replay.replayed(table.limit(0)).count() == 0


@pytest.mark.parametrize("member", ["long", "timestamp"])
def test_members_of_one_bucket_are_replayed_each_for_itself(spark, monkeypatch, member):
    monkeypatch.setattr(replay, "BUCKETS", 3)
    who = (lambda k: k) if member == "long" else (lambda k: dt.datetime(2024, 1, 1, 0, 0, 0, k))
    data = [(int(v == 1), "a", who(k), v, "toggle") for k in range(40) for v in range(1, 3 + k % 2)]  # the first change comes last
    got = in_parts(split(spark, data, f"part int, list string, member {member}, version long, op string"), replay.replay_stream, "update")
    assert {(r.member, r.version, r.present) for r in got.collect()} == {(who(k), 2 + k % 2, k % 2 == 1) if k % 2 else (who(k), 2, False) for k in range(40)}


def test_every_delivery_is_the_result_at_that_point(spark):
    rng = random.Random(8)
    data = [(k * 4 // 200, k, rng.choice(["set", "set", "set", "delete"]), rng.choice(["a", "b", "c", None]), rng.randrange(50)) for k in range(200)]
    schema = "part int, seq long, op string, id string, createdAt long"
    parts = [p.drop("part") for p in split(spark, data, schema)]
    view = lambda rows: ordering.ranked(rows, F.desc("createdAt"), F.desc("id"))
    got = live.deliveries(parts, view).collect()
    for n in range(4):
        state = {}
        for p, _, op, k, x in data:
            if p <= n:
                state.pop(k, None)
                if op == "set":
                    state[k] = x
        want = sorted(state.items(), key=lambda r: (-r[1], r[0] is None, [-ord(c) for c in r[0] or ""]))
        assert sorted((r.pos, r.id, r.createdAt) for r in got if r.part == n) == [(i + 1, k, x) for i, (k, x) in enumerate(want)]
