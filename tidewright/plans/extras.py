"""Queries over ordered, timed and grouped rows that the collections of ``catalog`` have no counterpart for.

The tables are those of ``catalog``. A stream's parts are slices of ``events`` in the order of their ids, of
which some rows come later than their neighbours. Times are given in microseconds of the epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import tables as U
from tidewright.functions import text as T
from tidewright.operators import grouping, intervals, ordering
from tidewright.sources.tables import table
from tidewright.streaming import event_time, live, replay
from tidewright.streaming.parts import in_parts

PARTS = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _micros(ts) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _arriving(events: DataFrame, late: int = 17, share: int = 2) -> DataFrame:
    """Events with the part of the stream in which they come; every ``late``-th comes a ``share``-th of the stream late."""
    n = events.agg(F.max("event_id") + 1).first()[0] or 1
    slip = F.when(F.col("event_id") % late == 0, n // share).otherwise(0)
    return events.withColumn("part", F.least(F.floor((F.col("event_id") + slip) * PARTS / n), F.lit(PARTS - 1)).cast("int"))


def _parts(rows: DataFrame, part: str = "part") -> list[DataFrame]:
    return [rows.where(F.col(part) == n).drop(part) for n in range(PARTS)]


_ARRIVING = f"(select *, least((event_id + case when event_id % 17 = 0 then n // 2 else 0 end) * {PARTS} // n, {PARTS - 1})::int as part from (select *, max(event_id) over () + 1 as n from events))"
_MARKS = "(select a.part, max(b.ts) - interval 1 day as mark from (select distinct part from r) a left join r b on b.part < a.part group by a.part)"


@query("select event_id, event_type, row_number() over (order by ts desc, event_id desc) as pos from events")
def ext_global_rank(spark, d):
    """The place of every event in one order."""
    return ordering.ranked(table(spark, d, "events").select("event_id", "event_type", "ts"), F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""select (pos - 1) // 250 as page, count(*) as rows, min_by(event_id, pos) as first_id, epoch_us(min_by(ts, pos)) as first_us, max_by(event_id, pos) as last_id, epoch_us(max_by(ts, pos)) as last_us
 from (select *, row_number() over (order by ts desc, event_id desc) as pos from events) group by 1""")
def ext_cursor_pages(spark, d):
    """All pages of 250 events, newest first, with the cursors that open and end each."""
    rows = ordering.ranked(table(spark, d, "events").select("event_id", "ts"), F.desc("ts"), F.desc("event_id"))
    pages = ordering.page_index(rows, ["ts", "event_id"], 250)
    ends = [(F.col(f"{c}.event_id").alias(f"{c}_id"), _micros(F.col(f"{c}.ts")).alias(f"{c}_us")) for c in ("first", "last")]
    return pages.select("page", "rows", *ends[0], *ends[1])


@query("""select event_id, user_id, event_type from events, (select max(struct_pack(ts, event_id)) as c from events where event_id % 2 = 0 and event_type = 'click') where (ts < c.ts or ts = c.ts and event_id < c.event_id) order by ts desc, event_id desc limit 100""")
def ext_cursor_next(spark, d):
    """The 100 events after a cursor, newest first."""
    events = table(spark, d, "events")
    cursor = events.where("event_id % 2 = 0 and event_type = 'click'").agg(F.max(F.struct("ts", "event_id")).alias("c")).first().c
    after = {"ts": cursor.ts, "event_id": cursor.event_id} if cursor else None
    return ordering.page_after(events, [("ts", True), ("event_id", True)], after, 100).select("event_id", "user_id", "event_type")


def _placed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a time and a user among those of events."""
    at = F.timestamp_add("SECOND", F.col("o_orderkey") * 7919 % 2_592_000, F.lit("2024-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("user_id"), at.alias("at"))


_PLACED = "(select o_orderkey, o_custkey % 200 as user_id, timestamp '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) as at_time from orders)"


@query(f"""with e as (select user_id, max(struct_pack(ts, event_id)) as last, ts from events group by user_id, ts)
select o_orderkey, e.last.event_id as event_id, epoch_us(e.last.ts) as at_us from {_PLACED} o asof left join e on o.user_id = e.user_id and o.at_time >= e.ts""")
def ext_asof_join(spark, d):
    """Each order with the last event of its user that is not later."""
    rows = ordering.as_of(_placed_orders(spark, d), table(spark, d, "events").select("ts", "event_id", "user_id"), "user_id", "at", "ts")
    return rows.select("o_orderkey", F.col("found.event_id").alias("event_id"), _micros(F.col("found.ts")).alias("at_us"))


_SESSIONS = """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as opens from events),
s as (select user_id, ts, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as n from e),
g as (select user_id, min(ts) as a, max(ts) as b, count(*) as rows from s group by user_id, n)
select user_id, epoch_us(a) as start_us, epoch_us(b) as end_us, rows from g"""


@query(_SESSIONS)
def ext_sessions(spark, d):
    """Sessions of each user: events at most six hours apart."""
    rows = ordering.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    return rows.select("user_id", _micros(F.col("start")).alias("start_us"), _micros(F.col("end")).alias("end_us"), "rows")


@query(_SESSIONS + " where b + interval 6 hour <= (select max(ts) from events) - interval 3 day")
def ext_session_stream(spark, d):
    """The same sessions from a stream whose rows come out of order, as far as the watermark has closed them."""
    parts = _parts(_arriving(_timed(spark, d), 29, 20).select("user_id", "ts", "part"))
    delay = "3 days"
    got = in_parts(parts, lambda s: event_time.user_sessions(s, "ts", delay, "6 hours", ["user_id"], F.count("*").alias("rows"), F.max("ts").alias("b")))
    return got.select("user_id", _micros(F.col("session_window.start")).alias("start_us"), _micros(F.col("b")).alias("end_us"), "rows")


def _window_sql(step: str) -> str:
    starts = "time_bucket(interval 1 day, ts)" if step == "day" else "unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour])"
    return f"""with r as {_ARRIVING}, w as (select *, {starts} as a from r)
select epoch_us(a) as start_us, event_type, count(*) as rows, sum((value * 100)::bigint)::bigint as cents from w join {_MARKS} m using (part)
where (mark is null or a + interval 1 day > mark) and a + interval 1 day <= (select max(ts) from r) - interval 1 day group by 1, 2"""


def _cents():
    return F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")


def _windows(spark, d, slide: str | None) -> DataFrame:
    parts = _parts(_arriving(_timed(spark, d)).select("ts", "event_type", "value", "part"))
    got = in_parts(parts, lambda s: event_time.windows(s, "ts", "1 day", "1 day", ["event_type"], F.count("*").alias("rows"), _cents(), slide=slide))
    return got.select(_micros(F.col("window.start")).alias("start_us"), "event_type", "rows", "cents")


@query(_window_sql("day"))
def ext_event_windows(spark, d):
    """Daily sums of a stream in append mode: too late rows are turned down, open windows not shown."""
    return _windows(spark, d, None)


@query(_window_sql("half"))
def ext_sliding_windows(spark, d):
    """Sums of a day, every half day, of the same stream."""
    return _windows(spark, d, "12 hours")


@query(f"""with e as (select event_id, ts, part from {_ARRIVING}), r as (select * from e union all select event_id, ts, least(part + 1, {PARTS - 1}) from e where event_id % 3 = 0)
select distinct event_id, epoch_us(ts) as at_us from r join {_MARKS} m using (part) where mark is null or ts > mark""")
def ext_stream_dedup(spark, d):
    """Each event once, of a stream that brings every third again in the next part."""
    rows = _arriving(_timed(spark, d)).select("event_id", "ts", "part")
    again = rows.where("event_id % 3 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(PARTS - 1)))
    got = in_parts(_parts(rows.union(again)), lambda s: event_time.distinct_rows(s, "ts", "1 day", ["event_id"]))
    return got.select("event_id", _micros(F.col("ts")).alias("at_us"))


_OPS = "case when event_id % 7 = 3 then 'add' when event_id % 11 = 5 then 'remove' else 'toggle' end"
_REPLAYED = f"""with c as (select event_type || '-' || (day(ts) - 1) // 10 as list, user_id as member, event_id as seq, {_OPS} as op from events),
f as (select list, member, max(case when op <> 'toggle' then seq end) as fixed, max_by(op, case when op <> 'toggle' then seq end) as last from c group by 1, 2),
p as (select list, member, (coalesce(any_value(last), '') = 'add') <> (count(*) filter (op = 'toggle' and (fixed is null or seq > fixed)) % 2 = 1) as present from c join f using (list, member) group by 1, 2)
select list, string_agg(member::varchar, ',' order by member) as members, count(*) as n from p where present group by list"""


def _changes(spark, d) -> DataFrame:
    name = F.concat_ws("-", "event_type", F.expr("(dayofmonth(ts) - 1) div 10").cast("string"))
    rows = table(spark, d, "events").select(name.alias("list"), F.col("user_id").alias("member"), "event_id", F.expr(_OPS).alias("op"))
    return ordering.ranked(rows, F.col("event_id"), within=("list", "member"), name="version")


def _listed(lists: DataFrame) -> DataFrame:
    return lists.select("list", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.size("members").cast("long").alias("n"))


@query(_REPLAYED)
def ext_replay(spark, d):
    """Lists after all toggles, additions and removals of their members, in order."""
    return _listed(replay.lists(replay.replayed(_changes(spark, d))))


@query(_REPLAYED)
def ext_replay_stream(spark, d):
    """The same lists from a stream in which changes come before their predecessors."""
    parts = _parts(_arriving(_changes(spark, d)).drop("event_id"))
    return _listed(replay.lists(in_parts(parts, replay.replay_stream, "update")))


@query(f"""with c as (select *, event_id * {PARTS} // (max(event_id) over () + 1) as part from events),
l as (select p.part, c.*, row_number() over (partition by p.part, user_id order by event_id desc) as n from (select distinct part::int as part from c) p join (select * exclude (part), part as own from c) c on own <= p.part)
select part, user_id, event_type, event_id, row_number() over (partition by part order by event_id desc) as pos from l where n = 1 and event_type <> 'error'""")
def ext_live_deliveries(spark, d):
    """The whole ordered result of a live collection after each of several batches of changes."""
    e = table(spark, d, "events")
    n = e.agg(F.max("event_id") + 1).first()[0] or 1
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    changes = e.select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", "event_type", "event_id", F.floor(F.col("event_id") * PARTS / n).alias("part"))
    return live.deliveries(_parts(changes), lambda rows: ordering.ranked(rows, F.desc("event_id")), "user_id")


_DELIVERY = "(select o_orderkey, user_id, epoch_us(at_time) as a, epoch_us(at_time) + (1 + o_orderkey % 97) * (1 + o_orderkey % 97) * 60000000 as b from " + _PLACED + ")"


def _delivery_spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a span that begins at their time and is a minute to six days long."""
    k, a = F.col("o_orderkey") % 97 + 1, _micros(F.col("at"))
    return _placed_orders(spark, d).select("o_orderkey", "user_id", a.alias("a"), (a + k * k * 60_000_000).alias("b"))


@query(f"select o_orderkey, event_id from {_DELIVERY} s join events e on e.user_id = s.user_id and epoch_us(ts) >= a and epoch_us(ts) < b")
def ext_interval_join(spark, d):
    """Events of a user within the spans of the user's orders."""
    events = table(spark, d, "events").select("event_id", "user_id", _micros(F.col("ts")).alias("t"))
    met = intervals.points_in_spans(events, _delivery_spans(spark, d), "t", "a", "b", on=(("user_id", "user_id"),))
    return met.select(F.col("span.o_orderkey").alias("o_orderkey"), F.col("point.event_id").alias("event_id"))


@query(f"""with v as (select s_suppkey, 1704067200000000 + s_suppkey * 7919 % 2592000 * 1000000 as a, 1704067200000000 + (s_suppkey * 7919 % 2592000 + (s_suppkey % 13) * (s_suppkey % 13) * 60) * 1000000 as b from supplier)
select s_suppkey, count(*) as orders, min(o_orderkey) as first_order, sum(least(v.b, s.b) - greatest(v.a, s.a))::bigint as shared_us from v join {_DELIVERY} s on v.a < s.b and s.a < v.b and v.a < v.b group by s_suppkey""")
def ext_span_overlap(spark, d):
    """Orders whose spans overlap a supplier's span, and the time that they share."""
    k = F.col("s_suppkey")
    a = F.lit(1_704_067_200_000_000) + k * 7919 % 2_592_000 * 1_000_000
    visits = table(spark, d, "supplier").select("s_suppkey", a.alias("a"), (a + (k % 13) * (k % 13) * 60_000_000).alias("b"))
    met = intervals.overlap_totals(visits, _delivery_spans(spark, d), "a", "b", "s_suppkey", "o_orderkey")
    return met.select("s_suppkey", F.col("n").alias("orders"), F.col("least").alias("first_order"), F.col("shared").alias("shared_us"))


@query("""select event_id, count(*) over w as rows, (sum(round(value * 100)::bigint) over w)::bigint as cents from events
 window w as (partition by event_type order by ts range between interval 36 hour preceding and current row)""")
def ext_moving_sums(spark, d):
    """For each event, those of its type in the 36 hours up to it, and their value."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("value"), F.lit(1).alias("one"))
    return ordering.moving_sums(rows, "event_type", "ts", 36 * 3600, rows="one", cents="value").select("event_id", "rows", "cents")


_QUANTITY = "sum(l_quantity::bigint)::bigint as quantity, sum(l_linenumber::bigint)::bigint as lines"
_YEAR = "(select *, year(l_shipdate)::bigint as year from lineitem)"


def _shipped(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("year"), "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"))


_DIMS = ["l_returnflag", "l_linestatus", "year"]
_GROUPED = "select l_returnflag, l_linestatus, year, grouping_id(l_returnflag, l_linestatus, year)::bigint as grouping_id, count(distinct l_suppkey) as distinct_l_suppkey, " + _QUANTITY + " from " + _YEAR


@query(_GROUPED + " group by cube (l_returnflag, l_linestatus, year)")
def ext_cube(spark, d):
    """Sums and suppliers for every set of three dimensions."""
    return grouping.grouped(_shipped(spark, d), _DIMS, grouping.cube_sets(_DIMS), "l_suppkey", quantity="q", lines="n")


@query(_GROUPED + " group by rollup (l_returnflag, l_linestatus, year)")
def ext_rollup(spark, d):
    """Sums and suppliers for each prefix of three dimensions."""
    return grouping.grouped(_shipped(spark, d), _DIMS, grouping.rollup_sets(_DIMS), "l_suppkey", quantity="q", lines="n")


@query(_GROUPED + " group by grouping sets ((l_returnflag, year), (l_linestatus), ())")
def ext_grouping_sets(spark, d):
    """Sums and suppliers for some sets of dimensions."""
    return grouping.grouped(_shipped(spark, d), _DIMS, [("l_returnflag", "year"), ("l_linestatus",), ()], "l_suppkey", quantity="q", lines="n")


@query("""select event_type, day(ts)::bigint // 8 as week, count(distinct user_id) as users, count(*) as rows, true as users_close, true as median_close from events group by 1, 2""")
def ext_merged_sketches(spark, d):
    """Users and median values of each eight days from daily sketches, against the exact ones: within 5 % and 3 % of rank."""
    e = table(spark, d, "events").select("event_type", F.dayofmonth("ts").cast("long").alias("day"), "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    week = F.expr("day div 8").alias("week")
    merged = grouping.merged_sketches(grouping.sketches(e, [F.col("event_type"), F.col("day")], "user_id", "cents"), F.col("event_type"), week)
    merged = merged.select("event_type", "week", "rows", F.hll_sketch_estimate("distinct_sketch").alias("guess"), F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(0.5)).alias("median"))
    below = F.sum((F.col("cents") < F.col("median")).cast("long")) / F.count("cents"), F.sum((F.col("cents") <= F.col("median")).cast("long")) / F.count("cents")
    exact = e.withColumn("week", week).join(merged, ["event_type", "week"]).groupBy("event_type", "week", "rows", "guess")
    exact = exact.agg(F.count_distinct("user_id").alias("users"), below[0].alias("low"), below[1].alias("high"))
    close = F.abs(F.col("guess") - F.col("users")) <= F.greatest(F.lit(1), F.col("users") * 0.05)
    return exact.select("event_type", "week", "users", "rows", close.alias("users_close"), ((F.col("low") <= 0.53) & (F.col("high") >= 0.47)).alias("median_close"))


@query("""with n as (select day(ts)::bigint % 2 as odd, user_id, count(*) as n from events group by 1, 2), t as (select odd, sum(n) as all_n from n group by 1)
select odd, user_id, n as exact, true as never_below, true as close from n join t using (odd)""")
def ext_count_min(spark, d):
    """Events of each user on odd and even days from daily count-min sketches: never below the count, and close to it."""
    e = table(spark, d, "events").select(F.dayofmonth("ts").cast("long").alias("day"), "user_id")
    cells = grouping.count_min(e, [F.col("day")], "user_id").groupBy((F.col("day") % 2).alias("odd"), "r", "c").agg(F.sum("n").alias("n"))
    exact = e.groupBy((F.col("day") % 2).alias("odd"), "user_id").agg(F.count("*").alias("exact"))
    total = exact.groupBy("odd").agg(F.sum("exact").alias("total"))
    guess = grouping.estimated(cells, ["odd"], exact.select("odd", "user_id"), "user_id")
    met = exact.join(guess, ["odd", "user_id"]).join(total, "odd")
    bound = F.greatest(F.lit(1), F.col("total") * 8 / grouping.COLUMNS)
    return met.select("odd", "user_id", "exact", (F.col("estimate") >= F.col("exact")).alias("never_below"), (F.col("estimate") - F.col("exact") <= bound).alias("close"))


@query("""with v as (select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as line from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i))
select doc_id, line_no::bigint as line_no, contains(lower(line), 'etre') as plain from v where contains(strip_accents(lower(line)), 'etre')""")
def ext_folded_search(spark, d):
    """Lines that hold a word whatever its accents and case, and whether case alone would have found it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = F.contains(F.lower("line"), F.lit("etre")).alias("plain")
    return lines.where(T.found_folded(F.col("line"), "ÊTRE")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), plain)


@query("""with w as (select distinct lang, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) as word from documents where lang in ('fr', 'es', 'de')),
k as (select lang, strip_accents(lower(word)) as key, count(*) as spellings, count(distinct lower(word)) as by_case from w group by 1, 2)
select lang, key, spellings, by_case, count(*) over (partition by key) as langs from k where spellings > 1""")
def ext_folded_groups(spark, d):
    """Words of three languages that differ by accents or case only, by their common key, and in how many languages it has several."""
    words = table(spark, d, "documents").where("lang in ('fr', 'es', 'de')").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]+"), 0)).alias("word")).distinct()
    keys = words.groupBy("lang", T.folded(F.col("word")).alias("key")).agg(F.count("*").alias("spellings"), F.count_distinct(F.lower("word")).alias("by_case")).where("spellings > 1")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("langs")), "key").select("lang", "key", "spellings", "by_case", "langs")


@query("""with e as (select user_id, event_type, event_id, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as cut from events),
s as (select *, sum(cut) over (partition by user_id order by event_id rows unbounded preceding) as g from e)
select user_id, event_type, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from s group by user_id, g, event_type""")
def ext_streaks(spark, d):
    """Stretches of events of one type of each user, by a table function."""
    rows = U.streaks(table(spark, d, "events"), "user_id", "event_type", "event_id")
    return rows.select(F.col("key").cast("long").alias("user_id"), F.col("value").alias("event_type"), F.col("first").alias("first_id"), F.col("last").alias("last_id"), "n")
