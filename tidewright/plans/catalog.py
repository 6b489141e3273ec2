"""Queries over the test tables, one for each group of operations, with DuckDB SQL for the same rows.

The tables stand in for collections: documents for a corpus, events for prayers, agenda and
changelog, pages for feeds. Order is given as a column ``pos``. ``now`` is 2024-02-01 00:00 UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import dates as D
from tidewright.functions import text as T
from tidewright.operators import collections as C
from tidewright.operators import corpus, feed, mutations, ordering
from tidewright.sources.tables import table
from tidewright.streaming import live

NOW_MS = 1_706_745_600_000
NEEDLE = "The on"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


SEARCH = f"""
with v as (select doc_id, i - 1 as verse, string_split(text, chr(10))[i] as line from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i)),
h as (select doc_id, verse::bigint as verse, line, row_number() over (order by doc_id, verse) as pos from v where contains(lower(line), lower('{NEEDLE}')))
select doc_id, verse, line, pos, 'doc ' || doc_id || ' 1:' || (verse + 1) as label from h where pos <= 60
"""


def _verses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return longs(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("verse", "line")), "verse")


@query(SEARCH)
def corpus_search(spark, d):
    hits = corpus.search(_verses(spark, d), f"  {NEEDLE} ", "doc_id", "verse", text="line")
    hits = hits.withColumn("label", corpus.reference(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.lit(0), F.col("verse")))
    return C.positions(hits, F.col("doc_id"), F.col("verse"))


@query("select doc_id, text as line, 0::bigint as verse from documents where false")
def corpus_search_short(spark, d):
    return corpus.search(_verses(spark, d), " on ", "doc_id", "verse", text="line")


@query("""select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as chapter, text,
 'conv ' || conv_id || ' ' || row_number() over (partition by conv_id order by turn, role, text) || ':1' as label, count(*) over (partition by conv_id) as chapters from conversations""")
def corpus_flatten(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("book")).agg(F.transform(turns, lambda t: F.array(t["text"])).alias("chapters"))
    nested = nested.withColumn("name", F.concat(F.lit("conv "), F.col("book").cast("string")))
    flat = corpus.flattened(nested).join(nested.select("book", F.size("chapters").alias("chapters")), "book")
    label = corpus.reference(F.col("name"), F.col("chapter"), F.col("verse"))
    return longs(flat.select(F.col("book").alias("conv_id"), "chapter", "text", label.alias("label"), "chapters"), "chapter", "chapters")


@query("select c_custkey, coalesce(n.n_name, c.c_name) as name, case when c_nationkey < 39 then 'AT' else 'NT' end as part from customer c left join (select * from nation where n_nationkey < 20) n on c_nationkey = n_nationkey")
def lookup_fallback(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("book"), F.col("n_name").alias("name"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("book"), F.col("c_name").alias("name"))
    return corpus.named(rows, names).select("c_custkey", "name", corpus.part_of(F.col("book")).alias("part"))


@query("""with t as (select distinct conv_id, turn from conversations)
select conv_id, turn, lag(conv_id) over w as prev_conv, lag(turn) over w as prev_turn, lead(conv_id) over w as next_conv, lead(turn) over w as next_turn,
 lag(turn) over w is not null as has_prev, lead(turn) over w is not null as has_next, lead(turn) over w is null as is_last from t window w as (order by conv_id, turn)""")
def nav_prev_next(spark, d):
    # The last turn of the conversation before and the first of the next come from each
    # conversation's ends, so that windows stay within a conversation and none takes all rows.
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    near = corpus.neighbours(turns, "conv_id", "turn", within=("conv_id",)).join(_around(ends), "conv_id", "left")
    prev, nxt = F.coalesce("prev", "before"), F.coalesce("next", "after")
    return near.select(
        "conv_id", "turn", prev["conv_id"].alias("prev_conv"), prev["turn"].alias("prev_turn"), nxt["conv_id"].alias("next_conv"), nxt["turn"].alias("next_turn"),
        prev.isNotNull().alias("has_prev"), nxt.isNotNull().alias("has_next"), nxt.isNull().alias("is_last"),
    )


def _around(ends: DataFrame, wide: int = 1024) -> DataFrame:
    """For each conversation the last turn of the one before and the first of the one after.

    Ids are dealt into ranges; a range's outermost conversations find theirs in the neighbouring
    ranges' ends.
    """
    ends = ends.withColumn("range", F.floor(F.col("conv_id") / wide))
    edge = ends.groupBy("range").agg(
        F.min(F.struct("conv_id", F.col("first").alias("turn"))).alias("head"), F.max(F.struct("conv_id", F.col("last").alias("turn"))).alias("tail")
    )
    w = C.Window.orderBy("range")  # one row for each 1,024 ids
    edge = edge.select("range", F.lag("tail").over(w).alias("tail_before"), F.lead("head").over(w).alias("head_after"))
    w = C.Window.partitionBy("range").orderBy("conv_id")
    before = F.lag(F.struct("conv_id", F.col("last").alias("turn"))).over(w)
    after = F.lead(F.struct("conv_id", F.col("first").alias("turn"))).over(w)
    inner = ends.select("conv_id", "range", before.alias("before"), after.alias("after")).join(edge, "range")
    return inner.select("conv_id", F.coalesce("before", "tail_before").alias("before"), F.coalesce("after", "head_after").alias("after"))


@query("select event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as pos, event_type from events")
def feed_desc(spark, d):
    return ordering.ranked(table(spark, d, "events").select("event_id", "ts", "event_type"), F.desc("ts"), F.desc("event_id"), within=("event_type",)).drop("ts")


def _agenda(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    date = F.concat(F.dayofmonth("ts").cast("string"), F.lit("/"), F.month("ts").cast("string"))
    return e.select("event_id", "event_type", date.alias("date"))


_AGENDA = "(select event_id, event_type, day(ts) || '/' || month(ts) as date from events)"


@query(f"select event_id, date, row_number() over (partition by event_type order by date, event_id) as pos, lead(event_id) over (partition by event_type order by date, event_id) is null as is_last from {_AGENDA}")
def agenda_text_order(spark, d):
    rows = ordering.ranked(_agenda(spark, d), F.col("date"), F.col("event_id"), within=("event_type",))
    ends = rows.groupBy("event_type").agg(F.max("pos").alias("end"))  # a row for each type
    return rows.join(ends, "event_type").select("event_id", "date", "pos", (F.col("pos") == F.col("end")).alias("is_last"))


@query(f"select event_id, date, row_number() over (partition by date order by event_id) as pos from {_AGENDA} where event_type = 'click'")
def agenda_tab(spark, d):
    rows = C.agenda_tab(_agenda(spark, d).withColumnRenamed("event_type", "type"), "click").select("event_id", "date")
    return ordering.ranked(rows, F.col("event_id"), within=("date",))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in D.MONTHS) + "]"


@query(f"select event_id, split_part(date, '/', 1) || ' de ' || ({_MONTHS})[split_part(date, '/', 2)::int] as label, split_part(date, '/', 1) || '/7' as moved, '9/' || split_part(date, '/', 2) as other_day from {_AGENDA}")
def agenda_label(spark, d):
    date = F.col("date")
    return _agenda(spark, d).select("event_id", D.day_label(date).alias("label"), D.with_month(date, F.lit(7)).alias("moved"), D.with_day(date, F.lit(9), 2).alias("other_day"))


@query("select d.doc_id, coalesce(quality, 0)::bigint as quality, coalesce(toxic, -1)::bigint as toxic from documents d left join labels l using (doc_id)")
def defaults(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return longs(C.with_defaults(rows, quality=0, toxic=-1), "quality", "toxic")


def _lists(spark, d) -> DataFrame:
    """Per event type and day the sorted list of its users, as who prayed for a request."""
    e = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    users = F.transform(F.array_sort(F.collect_set("user_id")), lambda u: u.cast("string"))
    return e.agg(users.alias("prayedBy"), F.min("user_id").cast("string").alias("authorId"))


_LISTS = """(select event_type, strftime(ts, '%Y-%m-%d') as day, list_transform(list_sort(list(distinct user_id)), lambda u: u::varchar) as users, min(user_id)::varchar as author from events group by 1, 2)"""


@query(f"""select event_type, day, list_contains(users, '7') as has_prayed, author = '7' as is_owner, len(users)::bigint as pray_count,
 case when len(users) = 1 then '1 pessoa orando' else len(users) || ' pessoas orando' end as label from {_LISTS}""")
def member_flags(spark, d):
    rows = C.prayer_flags(_lists(spark, d), "7")
    label = T.count_label(F.col("prayCount"), "pessoa orando", "pessoas orando")
    return rows.select("event_type", "day", F.col("hasPrayed").alias("has_prayed"), F.col("isOwner").alias("is_owner"), F.col("prayCount").cast("long").alias("pray_count"), label.alias("label"))


@query(f"""select event_type, day, array_to_string(case when list_contains(users, '7') then list_filter(users, lambda u: u <> '7') else list_append(users, '7') end, ',') as users from {_LISTS}""")
def member_toggle(spark, d):
    return _lists(spark, d).select("event_type", "day", F.array_join(T.toggled(F.col("prayedBy"), F.lit("7")), ",").alias("users"))


@query("select o_orderkey, o_totalprice from orders where o_custkey = 7")
def private_rows(spark, d):
    return C.own(table(spark, d, "orders"), "7", owner="o_custkey").select("o_orderkey", "o_totalprice")


@query("""select c_custkey, true as folded, c_name in ('customer#000000002', 'Customer#000000005') as exact from customer
 where lower(c_name) in ('customer#000000002', 'customer#000000005', 'customer#000000009')""")
def admin_semi(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    folded = C.admins(rows, ["customer#000000002", "customer#000000005", "customer#000000009"], "c_name")
    exact = C.admins(rows, ["customer#000000002", "Customer#000000005"], "c_name", fold=False).select("c_custkey", F.lit(True).alias("exact"))
    return folded.join(exact, "c_custkey", "left").select("c_custkey", F.lit(True).alias("folded"), F.coalesce("exact", F.lit(False)).alias("exact"))


def _decoded_sql(x: str) -> str:
    for name, char in T.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


@query(f"select page_id, {_decoded_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} as title from pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.decoded(feed.first_group(F.col("html"), "<title>(.*?)</title>")).alias("title"))


@query("""select page_id, (i - 1)::bigint as pos, m[i] as item from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) as m from pages), lateral (select unnest(range(1, len(m) + 1)) as i) where m[i] <> ''""")
def page_links(spark, d):
    rows = feed.blocks(table(spark, d, "pages").select("page_id", "html"), "html", "<li>(.*?)</li>")
    return longs(rows.where("block <> ''").select("page_id", "pos", F.col("block").alias("item")), "pos")


@query("select 'empty' as variant, * from (values (1::bigint, 'a'), (2, 'b'), (3, 'c')) t(id, name) union all select 'live', page_id, url from pages")
def fallback_if_empty(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    static = spark.sql("select * from values (1L, 'a'), (2L, 'b'), (3L, 'c') as t(id, name)")
    empty = feed.first_source([pages.where("id < 0"), pages.where("id < -1")], static)
    return empty.select(F.lit("empty").alias("variant"), "*").union(C.first_non_empty(pages, static).select(F.lit("live"), "*"))


_DAYS = f"floor(({NOW_MS} - epoch_ms(ts)) / 86400000.0)::bigint"
_RELATIVE = """case when d = 0 then 'Hoje' when d = 1 then 'Há 1 dia' when d < 7 then 'Há ' || d || ' dias' when d < 14 then 'Há 1 semana'
 when d < 30 then 'Há ' || d // 7 || ' semanas' when d // 30 = 1 then 'Há 1 mês' when d // 30 < 12 then 'Há ' || d // 30 || ' meses'
 when d // 30 // 12 = 1 then 'Há 1 ano' else 'Há ' || d // 30 // 12 || ' anos' end"""


@query(f"""select 'e' as kind, event_id as id, {_RELATIVE} as label from (select event_id, {_DAYS} as d from events)
 union all select 'o', o_orderkey, {_RELATIVE} from (select o_orderkey, {_DAYS.replace("(ts)", "(o_orderdate)")} as d from orders)""")
def relative_time(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    label = lambda c: D.relative_days(D.millis(F.col(c)), NOW_MS).alias("label")
    return e.select(F.lit("e").alias("kind"), F.col("event_id").alias("id"), label("ts")).union(o.select(F.lit("o"), "o_orderkey", label("o_orderdate")))


@query(f"""select event_id, case when m < 1 then 'agora' when m < 60 then m || 'min' when m < 1440 then m // 60 || 'h' else m // 1440 || 'd' end as label
 from (select event_id, floor(({NOW_MS - 43200000} - epoch_ms(ts)) / 60000.0)::bigint as m from events)""")
def time_ago(spark, d):
    return table(spark, d, "events").select("event_id", D.time_ago(D.millis(F.col("ts")), NOW_MS - 43_200_000).alias("label"))


@query("""select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as label, strftime(o_orderdate - interval 3 hour, '%d/%m/%Y') as west,
 strftime(o_orderdate, '%d/%m/%Y') as from_iso from orders""")
def format_date(spark, d):
    ms = D.millis(F.col("o_orderdate"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "orders").select("o_orderkey", D.date_of_ms(ms).alias("label"), D.date_of_ms(ms, "-03:00").alias("west"), D.published_date(iso).alias("from_iso"))


@query("""select c_custkey, case when length(p) <= 2 then p when length(p) <= 7 then '(' || substr(p, 1, 2) || ') ' || substr(p, 3)
 else '(' || substr(p, 1, 2) || ') ' || substr(p, 3, 5) || '-' || substr(p, 8, 4) end as phone, length(q) between 10 and 11 as valid
 from (select c_custkey, left(q, 11) as p, q from (select c_custkey, (c_custkey * 7919 * c_custkey * c_custkey)::varchar as q from customer))""")
def phone_format(spark, d):
    k = F.col("c_custkey").cast("decimal(12,0)")  # a product of 64 bits overflows from 105,214 on
    raw = F.concat(F.lit("+ "), (k * k * k * F.lit(7919).cast("decimal(4,0)")).cast("decimal(38,0)").cast("string"))
    return table(spark, d, "customer").select("c_custkey", T.phone(raw).alias("phone"), T.phone_valid(raw).alias("valid"))


@query("""select p_partkey, upper(case when len(w) >= 2 then left(w[1], 1) || left(w[len(w)], 1) else left(p_name, 2) end) as initials
 from (select p_partkey, p_name, string_split(p_name, ' ') as w from part)""")
def initials(spark, d):
    return table(spark, d, "part").select("p_partkey", T.initials(F.col("p_name")).alias("initials"))


@query("select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') as shown from pages")
def display_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.display_url(F.col("url")).alias("shown"))


@query(r"""select s_suppkey, regexp_matches(trim(m), '^[^\s@]+@[^\s@]+\.[^\s@]+$') as ok from
 (select s_suppkey, case s_suppkey % 3 when 0 then ' ' || s_name || '@mail.example ' when 1 then s_name || '@mail' else 'a b@' || s_name || '.c' end as m from supplier)""")
def email_check(spark, d):
    text = F.expr("case s_suppkey % 3 when 0 then ' ' || s_name || '@mail.example ' when 1 then s_name || '@mail' else 'a b@' || s_name || '.c' end")
    return table(spark, d, "supplier").select("s_suppkey", T.email_ok(text).alias("ok"))


@query("""select doc_id, coalesce(nullif(case when quality = 1 then 'p' || doc_id else '' end, ''), nullif(case when toxic = 1 then 't' || doc_id else '' end, '')) as preview,
 coalesce(nullif(case when toxic = 1 then 'x' else '' end, ''), 'Anônimo') as author from labels""")
def note_preview(spark, d):
    when = lambda c, x: F.when(F.col(c) == 1, x).otherwise(F.lit(""))
    tag = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    preview = T.truthy_or(when("quality", tag("p")), F.nullif(when("toxic", tag("t")), F.lit("")))
    return table(spark, d, "labels").select("doc_id", preview.alias("preview"), T.truthy_or(when("toxic", F.lit("x")), "Anônimo").alias("author"))


@query("""select event_id, (k % 2 = 0) as dark, coalesce(case when k % 3 <> 0 then k end, 16)::double as size from (select event_id, (props->>'k')::bigint as k from events)""")
def json_settings(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    size = F.when(k % 3 != 0, k.cast("double"))
    stored = F.to_json(F.struct((k % 2 == 0).alias("darkMode"), size.alias("fontSize")))  # a null field is left out
    read = T.settings(stored)
    return table(spark, d, "events").select("event_id", read["darkMode"].alias("dark"), read["fontSize"].alias("size"))


@query("""select r_name, n_name, row_number() over w as pos, lead(n_name) over w is null as is_last from region join nation on r_regionkey = n_regionkey window w as (partition by r_regionkey order by n_nationkey)""")
def sections_explode(spark, d):
    nested = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("leaders"))
    sections = table(spark, d, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"))
    rows = sections.select("r_name", F.size("leaders").alias("n"), F.posexplode("leaders").alias("i", "leader"))
    return rows.select("r_name", F.col("leader.n_name").alias("n_name"), (F.col("i") + 1).cast("long").alias("pos"), (F.col("i") == F.col("n") - 1).alias("is_last"))


@query(f"""select event_type, m.i as month, ({_MONTHS})[m.i] as name, d.i as day, d.i || '/' || m.i as date from (select event_type, min(month(ts)) as a, max(month(ts)) as b, max(day(ts)) as n from events group by 1) e,
 lateral (select unnest(range(e.a, e.b + 1)) as i) m, lateral (select unnest(range(1, e.n + 1)) as i) d
 union all select 'none', m.i, ({_MONTHS})[m.i], d.i, d.i || '/' || m.i from (select count(*) as n from events where event_type = 'none') e, range(1, 13) m(i), lateral (select unnest(range(1, e.n + 1)) as i) d""")
def day_grid(spark, d):
    """Months and days to choose from, up to the latest that the events of a type have; without events there is no day."""
    e = table(spark, d, "events")
    bounds = e.groupBy("event_type").agg(F.min(F.month("ts")).alias("a"), F.max(F.month("ts")).alias("b"), F.max(F.dayofmonth("ts")).alias("n"))
    none = e.where("event_type = 'none'").agg(F.count("*").cast("int").alias("n")).select(F.lit("none").alias("event_type"), F.lit(1).alias("a"), F.lit(12).alias("b"), "n")
    counted = lambda a, b: F.explode(F.when(b >= a, F.sequence(a.cast("long"), b.cast("long"))))
    months = bounds.unionByName(none).select("event_type", "n", counted(F.col("a"), F.col("b")).alias("month"))
    grid = months.select("event_type", "month", counted(F.lit(1), F.col("n")).alias("day"))
    name = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), F.col("month").cast("int"))
    return grid.select("event_type", "month", name.alias("name"), "day", F.concat("day", F.lit("/"), "month").alias("date"))


@query("""with p as (select s_suppkey + 50 as k, 'new ' || s_suppkey as name from supplier)
select coalesce(s_suppkey, k) as s_suppkey, coalesce(name, s_name) as s_name, s_acctbal from supplier full join p on s_suppkey = k""")
def upsert_merge(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patch = base.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.concat(F.lit("new "), F.col("s_suppkey").cast("string")).alias("s_name"))
    return mutations.merged(base, patch, "s_suppkey")


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)")
def delete_rows(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return mutations.deleted(base, base.where("s_acctbal < 0"), "s_suppkey").select("s_suppkey", "s_name")


@query("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey from supplier union all select 1000001, 'Added', null")
def insert_rows(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return mutations.inserted(base, spark.sql("select 1000001L as s_suppkey, 'Added' as s_name"))


@query("""select p_partkey, case when p_size < 32 then p_size + 1 else p_size end::bigint as up, case when p_size > 12 then p_size - 1 else p_size end::bigint as down from part""")
def font_step(spark, d):
    size = F.col("p_size")
    return longs(table(spark, d, "part").select("p_partkey", T.stepped(size, 1).alias("up"), T.stepped(size, -1).alias("down")), "up", "down")


@query("""select p_partkey, p_name as trimmed, true as name_filled, p_size > 25 as both_filled, true as any_filled from part""")
def trim_blank(spark, d):
    name = F.concat(F.lit(" \t "), F.col("p_name"), F.lit(" 　\n"))
    size = F.when(F.col("p_size") > 25, "x").otherwise(F.lit("  "))
    return table(spark, d, "part").select(
        "p_partkey", T.trimmed(name).alias("trimmed"), T.filled(name).alias("name_filled"), T.all_filled(name, size).alias("both_filled"), T.any_filled(size, name).alias("any_filled")
    )


@query("""select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type <> 'error'""")
def live_snapshot(spark, d):
    e = table(spark, d, "events")
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "user_id", "event_type", "event_id")
    return live.latest(changes, "user_id")


@query("""select user_id, event_type, event_id, row_number() over (order by event_id desc) as pos from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type <> 'error'""")
def live_stream(spark, d):
    """The live view of a stream of changes, read to its end: what the last delivery of the subscription shows."""
    source = table(spark, d, "events")
    e = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")  # a pattern: the table may be one file
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "user_id", "event_type", "event_id")
    return live.read_to_end(changes, lambda rows: ordering.ranked(rows, F.desc("event_id")), "user_id")


@query("""select user_id, event_id, event_type, row_number() over (order by ts desc, event_id desc) as pos from events where event_type = 'click'""")
def events_view(spark, d):
    """A filtered and ordered view of a collection."""
    e = table(spark, d, "events").where(F.col("event_type") == "click")
    return ordering.ranked(e.select("user_id", "event_id", "event_type", "ts"), F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""select c_custkey, c_mktsegment as collection, a as action,
  case c_mktsegment when 'AUTOMOBILE' then c_custkey % 5 = 3 when 'BUILDING' then c_custkey % 7 = 3
    when 'MACHINERY' then a in ('read', 'update') or c_custkey % 7 = 3 else a = 'read' end as user_may,
  case c_mktsegment when 'AUTOMOBILE' then c_custkey % 5 = 3 when 'BUILDING' then c_custkey % 7 = 3
    when 'MACHINERY' then a in ('read', 'update') or c_custkey % 7 = 3 else true end as admin_may, false as nobody_may
from customer, (select unnest(['read', 'create', 'update', 'delete']) as a)""")
def access_rules(spark, d):
    """Which rows of each collection a user, an administrator and nobody may read, create, update and delete."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 5).cast("string").alias("id"), (F.col("c_custkey") % 7).cast("string").alias("authorId"))
    kinds = {"AUTOMOBILE": "usuarios", "BUILDING": "anotacoes", "MACHINERY": "oracoes"}

    def rule(action: str, uid: str | None, admin: bool):
        out = C.may("noticias", action, uid, admin)
        for segment, kind in kinds.items():
            out = F.when(F.col("c_mktsegment") == segment, C.may(kind, action, uid, admin)).otherwise(out)
        return out

    each = [F.struct(F.lit(a).alias("action"), rule(a, "3", False).alias("user_may"), rule(a, "3", True).alias("admin_may"), rule(a, None, False).alias("nobody_may")) for a in ("read", "create", "update", "delete")]
    return rows.select("c_custkey", F.col("c_mktsegment").alias("collection"), F.explode(F.array(*each)).alias("r")).select("c_custkey", "collection", "r.*")


@query("""select page_id, 0::bigint as pos, 'v' || page_id as id, url || ' & "x"' as title, '2024-01-05T10:00:00Z' as published,
  'https://i.ytimg.com/vi/v' || page_id || '/hqdefault.jpg' as thumbnail, 'https://www.youtube.com/watch?v=v' || page_id as url from pages""")
def feed_videos(spark, d):
    """Entries of video feeds; an entry without an id is none."""
    xml = F.concat(
        F.lit("<feed><entry>\n<yt:videoId>v"), F.col("page_id").cast("string"), F.lit("</yt:videoId>\n<title>"), F.col("url"),
        F.lit(" &amp; &quot;x&quot;</title><published>2024-01-05T10:00:00Z</published></entry><entry><title>none</title></entry></feed>"),
    )
    videos = feed.videos(table(spark, d, "pages").select(xml.alias("xml")))
    return longs(videos.select(F.regexp_extract("id", "v(.*)", 1).cast("long").alias("page_id"), "*"), "pos")


@query("""select s_suppkey, s_name, 0::bigint as prayed from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_name, 1 from supplier where s_suppkey % 2 = 1""")
def list_default(spark, d):
    """Rows inserted without their list get an empty one."""
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", F.array(F.col("s_name")).alias("prayedBy"))
    rows = mutations.inserted(base.where("s_suppkey % 2 = 1"), base.where("s_suppkey % 2 = 0").drop("prayedBy"))
    return longs(C.with_defaults(rows, prayedBy=[]).select("s_suppkey", "s_name", F.size("prayedBy").alias("prayed")), "prayed")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'patched' else s_name end as s_name, s_acctbal from supplier")
def patch_allowed(spark, d):
    """A patch of fields of which only some may be set."""
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patch = base.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("patched").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return mutations.patched(base, patch, "s_suppkey", allowed=["s_name"])


@query("select s_suppkey, case when s_suppkey % 3 <> 0 then s_name end as s_name, s_acctbal from supplier")
def replace_rows(spark, d):
    """Whole rows set: fields that the new rows lack are gone."""
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return mutations.replaced(base, base.where("s_suppkey % 3 = 0").drop("s_name"), "s_suppkey")


@query("""select s_suppkey, case when s_suppkey = 3 then 'edited' else s_name end as s_name, 'update' as kind from supplier
  union all (select s_suppkey, s_name, 'insert' from supplier union all select 1000003, 'edited', 'insert')""")
def save_edit(spark, d):
    """A form that is saved: over the row being edited, or as a new one."""
    base = table(spark, d, "supplier").select("s_suppkey", "s_name")
    row = spark.sql("select 1000003L as s_suppkey, 'edited' as s_name")
    done = mutations.saved(base, row, 3, "s_suppkey"), mutations.saved(base, row, None, "s_suppkey")
    return done[0].withColumn("kind", F.lit("update")).unionByName(done[1].withColumn("kind", F.lit("insert")))


@query("select s_suppkey, case when s_suppkey = 4 then 'u1' when s_suppkey % 2 = 0 then 'u1,u2' else 'u2' end as prayed from supplier")
def toggle_row(spark, d):
    """Membership turned over in one row of a collection."""
    lists = F.when(F.col("s_suppkey") == 4, F.array(F.lit("u1"), F.lit("u2"))).when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("u1"), F.lit("u2"))).otherwise(F.array(F.lit("u2")))
    rows = mutations.toggle_prayed(table(spark, d, "supplier").select("s_suppkey", lists.alias("prayedBy")), 4, "u2", "s_suppkey")
    return rows.select("s_suppkey", F.array_join("prayedBy", ",").alias("prayed"))


@query(f"""with e as (select event_id, epoch_ms(ts) as ms, strftime(ts, '%d/%m/%Y') as date from events),
n as (select *, floor(({NOW_MS} - ms) / 86400000.0)::bigint as days, floor(({NOW_MS} - ms) / 86400000.0 / 30)::bigint as months from e)
select event_id, date || ' • ' || case when days = 0 then 'Hoje' when days = 1 then 'Há 1 dia' when days between 2 and 6 then 'Há ' || days || ' dias' when days < 7 then 'Há ' || days || ' dias'
  when days < 14 then 'Há 1 semana' when days < 30 then 'Há ' || (days // 7) || ' semanas' when months = 1 then 'Há 1 mês' when months < 12 then 'Há ' || months || ' meses'
  when months // 12 = 1 then 'Há 1 ano' else 'Há ' || (months // 12) || ' anos' end as meta from n""")
def video_meta(spark, d):
    """Date and relative time in one line."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", D.published_meta(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), NOW_MS).alias("meta"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'Orando' else 'Orar' end as pray, case when c_custkey % 3 = 0 then 'Admin' else 'Membro' end as badge,
  c_nationkey || '-' || c_custkey || '-' || (c_custkey % 4) || '-0' as key from customer""")
def row_labels(spark, d):
    """Labels by a flag, and composite keys of rows."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.pray_label(k % 2 == 0).alias("pray"), T.role_badge(k % 3 == 0).alias("badge"), T.row_key(F.col("c_nationkey"), k, k % 4, F.lit(0)).alias("key"))


@query("""select p_partkey, p_size % 2 = 0 as equal, length(p_brand) >= 6 as long_enough,
  case when p_size % 2 <> 0 then 'mismatch' when length(p_brand) < 6 then 'short' else 'ok' end as verdict from part""")
def password_check(spark, d):
    """Two fields that must agree, and the least length of one."""
    word, again = F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("other"))
    equal, enough = T.same(word, again), T.at_least(word, 6)
    return table(spark, d, "part").select("p_partkey", equal.alias("equal"), enough.alias("long_enough"), F.when(~equal, "mismatch").when(~enough, "short").otherwise("ok").alias("verdict"))


@query("""select p_partkey, replace(replace(replace(replace(p_name || ' a+b/ç!', '/', '%2F'), '+', '%2B'), ' ', '%20'), 'ç', '%C3%A7') as encoded,
  case p_size % 3 when 0 then 'https://a' when 1 then 'https://i' else 'https://s' end as store,
  case when p_size % 2 = 0 then 'route' else 'url' end as kind, case when p_size % 2 = 0 then '/r' || p_partkey else 'u' || p_partkey end as goes_to,
  case when p_size % 5 = 0 then 'own' when p_size % 5 = 1 then 'one' when p_size % 5 = 2 then 'two' else 'none' end as by_key from part""")
def link_targets(spark, d):
    """Encoded texts, the store of a platform, where an entry leads, and lookups with an explicit value and a fallback."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    platform = F.when(n % 3 == 0, "android").when(n % 3 == 1, "ios").otherwise("web")
    to = T.target(F.when(n % 2 == 0, F.concat(F.lit("/r"), k)), F.concat(F.lit("u"), k))
    found = T.by_key({"1": "one", "2": "two", "x": "none"}, (n % 5).cast("string"), "x", F.when(n % 5 == 0, "own"))
    return table(spark, d, "part").select(
        "p_partkey", T.uri_component(F.concat("p_name", F.lit(" a+b/ç!"))).alias("encoded"), T.store_url(platform, F.lit("https://a"), F.lit("https://i"), F.lit("https://s")).alias("store"),
        to["kind"].alias("kind"), to["to"].alias("goes_to"), found.alias("by_key"),
    )


@query("""select event_id, '14/01/2024' as today, '2024-01-15T01:30:00.007Z' as now, strftime(ts - interval 3 hour, '%d/%m/%Y') = '14/01/2024' as is_today, strftime(make_timestamp(epoch_ms(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as at
 from (select event_id, date_trunc('millisecond', ts) as ts from events)""")
def today_labels(spark, d):
    """Today and now as texts, from one moment, and the rows of today where the device is."""
    now, zone = 1_705_282_200_007, "-03:00"
    ms = D.millis(F.col("ts"))
    today = D.today(now, zone)
    return table(spark, d, "events").select("event_id", today.alias("today"), D.iso_of_ms(F.lit(now)).alias("now"), (D.date_of_ms(ms, zone) == today).alias("is_today"), D.iso_of_ms(ms).alias("at"))


@query("select event_id, tab from events, (select unnest(['aniversariantes', 'click']) as tab) where case event_type when 'signup' then 'aniversariantes' else event_type end = tab")
def agenda_tabs(spark, d):
    """The rows of two tabs, one of which has the plural of its type's name."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "signup", "aniversariante").otherwise(F.col("event_type")).alias("type"))
    shown = [C.agenda_tab(rows, tab).select("event_id", F.lit(tab).alias("tab")) for tab in ("aniversariantes", "click")]
    return shown[0].union(shown[1])


@query("select p_partkey, p_partkey % 66 as book, case when p_partkey % 66 < 39 then 'AT' else 'NT' end as part, p_partkey % 66 = 39 as opens from part")
def part_headers(spark, d):
    """The part of each book of 66, and the book that opens the second."""
    book = F.col("p_partkey") % 66
    return table(spark, d, "part").select("p_partkey", book.alias("book"), corpus.part_of(book).alias("part"), (book == corpus.SECOND_PART).alias("opens"))


@query("""with c as (select conv_id, list(text order by turn, role, text) as chapters from conversations group by 1)
select conv_id, case when conv_id % 4 = 3 then null else conv_id % 9 - 2 end as asked, case when conv_id % 4 <> 3 and conv_id % 9 >= 2 and conv_id % 9 - 2 < len(chapters) then chapters[(conv_id % 9 - 1)::int] else 'kept' end as text from c""")
def chapter_lookup(spark, d):
    """A chapter of each conversation that may not be there; what was shown stays then."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("chapters"))
    asked = F.when(F.col("conv_id") % 4 != 3, F.col("conv_id") % 9 - 2)
    return nested.select("conv_id", asked.alias("asked"), corpus.chapter_or_kept(F.col("chapters"), asked.cast("int"), F.lit("kept")).alias("text"))


@query("select c_custkey, 'data:' || c_custkey as photo from customer where c_custkey = 8 union all select c_custkey, 'own' from customer where c_custkey % 10 = 7")
def point_reads(spark, d):
    """A user's photo, none where it is empty or there is no such user; and the rows of one owner, none for nobody."""
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("data:"), F.col("c_custkey").cast("string"))).otherwise(F.lit("")).alias("fotoBase64"), (F.col("c_custkey") % 10).cast("string").alias("authorId"))
    photos = [C.photo(users, uid).select(F.lit(int(uid)).cast("long").alias("c_custkey"), F.col("fotoBase64").alias("photo")) for uid in ("8", "9", "-1")]
    mine = [C.own(users, uid).select(F.col("id").cast("long"), F.lit("own")) for uid in ("7", "")]
    return photos[0].union(photos[1]).union(photos[2]).union(mine[0]).union(mine[1])


@query("with l as (select p as part, e.* from (select unnest([0, 1]) as p) q, lateral (select * from (select *, row_number() over (partition by user_id order by event_id desc) as n from (select *, max(event_id) over () as m from events) where event_id <= m // 2 or p = 1) where n = 1 and event_type <> 'error') e) " + """
select 'agenda' as view, part, user_id, row_number() over (partition by part order by day(ts) || '/' || month(ts), user_id) as pos, day(ts) || '/' || month(ts) as shown from l
union all select 'prayers', part, user_id, row_number() over (partition by part order by ts desc, user_id desc), case when event_type = 'view' then '' else event_type end from l
union all select 'notes', part, user_id, row_number() over (partition by part order by ts desc, user_id desc), event_type from l where user_id % 10 = 7""")
def live_views(spark, d):
    """Three subscriptions after each of two batches: by the text of a date, with defaults, and of one owner."""
    e = table(spark, d, "events")
    half = F.floor(F.lit(e.agg(F.max("event_id")).first()[0] or 0) / 2)
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "user_id", "event_type", "ts")
    parts = [changes.where(F.col("seq") <= half), changes.where(F.col("seq") > half)]
    date = F.concat(F.dayofmonth("ts").cast("string"), F.lit("/"), F.month("ts").cast("string"))
    newest = F.desc("ts"), F.desc("user_id")
    views = {
        "agenda": lambda rows: ordering.ranked(rows.select("user_id", date.alias("shown")), F.col("shown"), F.col("user_id")),
        "prayers": lambda rows: ordering.ranked(C.with_defaults(rows.select("user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("shown")), shown=""), *newest).drop("ts"),
        "notes": lambda rows: ordering.ranked(C.own(rows.select("user_id", "ts", F.col("event_type").alias("shown"), (F.col("user_id") % 10).cast("string").alias("authorId")), "7"), *newest).drop("ts", "authorId"),
    }
    shown = [live.deliveries(parts, view, "user_id").select(F.lit(name).alias("view"), "part", "user_id", "pos", "shown") for name, view in views.items()]
    return shown[0].union(shown[1]).union(shown[2])
