"""Merkle fixity audit of WARC archives and their replicas.

Pages are records of WARC archives: an archive holds the records of a range of ``PER_ARCHIVE`` ids in
id order, so each record has an offset and a length in it. The tree of a copy is built from that copy
alone, where it lies. A leaf stands for an id: it holds the number of its records, their bytes, and a
hash of their SHA-256. A node holds the bytes of its up to 16 children and the SHA-256 of their numbers,
lengths and hashes in order. The lengths in order fix the offset range of every child within its
parent, so the root fixes all offsets and bytes; and a record that is missing changes its own
path to the root only, not the hashes of what follows it. Two replicas are compared from the root
down. Only children of nodes that differ are looked at on the next level, so the descent reads a few
nodes for each damaged record, and ends at the damaged records.

Records of one id have no order: their hash is the sum of their SHA-256, so that an id (or no id) that a
third of all rows have is summed in parts, and its offsets are prefix sums in two steps.

Defined results
---------------
* null url or html is empty, texts may be of any length. A null id is an id of its own, below all
  others, with an archive of its own (null). Ids may be negative.
* repeated rows (equal in id, url and html) are one record; rows of one id with other content
  are further records of that id, in the order of their hash.
* status is ``same``, ``altered`` (an id with one record in either copy, whose bytes differ),
  ``missing`` or ``extra`` (a record that the replica lacks, or only the replica has).
* two empty copies give an empty result. Columns besides page_id, url, html are not read, so their
  names may clash with those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.sources.tables import table

#: Ids of an archive, and children of a node as a power of two.
PER_ARCHIVE, FANOUT_BITS = 512, 4
#: Records of one id that one step of a prefix sum takes, about.
PER_STEP = 1024
#: Nodes of a level, or ids that differ, in one file.
PER_FILE = 1 << 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A record as it is stored: header, payload, and the empty lines that end it."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(kind, id, archive, n_bytes, sha256): the records of ``pages``; kind is 0 and id 0 where there is no id, else 1."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    own = F.col("page_id").cast("long")
    return pages.select(
        F.when(own.isNull(), 0).otherwise(1).alias("kind"),
        F.coalesce(own, F.lit(0).cast("long")).alias("id"),
        F.floor(own / PER_ARCHIVE).alias("archive"),
        F.octet_length(record).cast("long").alias("n_bytes"),
        F.sha2(record, 256).alias("sha256"),
    ).distinct()


def with_offsets(rows: DataFrame) -> DataFrame:
    """Records with their offset in the archive: that of their step, and that within the step.

    The records of an id are one step, or as many ranges of their hash as its number of records asks for.
    """
    ids = rows.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_STEP)
    steps = ids.select("kind", "id", F.least(F.lit(28), F.ceil(F.log2(F.col("n") / PER_STEP))).cast("int").alias("bits"))
    rows = rows.join(steps, ["kind", "id"], "left")
    step = F.expr("shiftright(cast(conv(substring(sha256, 1, 7), 16, 10) as long), 28 - bits)")  # of 28 bits
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0).cast("long")))
    # Spark cuts no window, so what one sees is bounded: a step, or the sums of an archive's steps.
    sums = rows.groupBy("kind", "archive", "id", "step").agg(F.sum("n_bytes").alias("bytes"))
    before = Window.partitionBy("kind", "archive").orderBy("id", "step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("kind", "id", "step", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("kind", "id", "step").orderBy("sha256").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(sums, ["kind", "id", "step"])
    return rows.withColumn("record_offset", (F.col("base") + F.col("inside")).cast("long")).drop("bits", "step", "base", "inside")


def leaves(rows: DataFrame) -> DataFrame:
    """(kind, node, bytes, hash) of each id."""
    quarters = [F.sum(F.conv(F.substring("sha256", 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"q{k}") for k in range(4)]
    rest = F.sum(F.conv(F.concat(*[F.substring("sha256", 16 * k + 16, 1) for k in range(4)]), 16, 10).cast("long")).alias("q4")
    sums = rows.groupBy("kind", F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), *quarters, rest)
    return sums.select("kind", "node", "bytes", F.sha2(F.concat_ws(":", "n", "bytes", *[f"q{k}" for k in range(5)]), 256).alias("hash"))


def parents(level: DataFrame, last: bool = False) -> DataFrame:
    """The level above: each node of at most 16 children in order; at the ``last`` step the root over all that is left."""
    children = F.array_sort(F.collect_list(F.struct("kind", "node", "bytes", "hash")))
    above = level.groupBy(*[x.alias(c) for x, c in zip(_up(last), ("kind", "up"), strict=True)]).agg(children.alias("c"), F.sum("bytes").alias("bytes"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["kind"], x["node"], x["bytes"], x["hash"])), ",")
    return above.select("kind", F.col("up").alias("node"), "bytes", F.sha2(text, 256).alias("hash"))


def _up(last: bool) -> tuple[Column, Column]:
    """Kind and number of a node's parent."""
    return (F.lit(0), F.lit(0).cast("long")) if last else (F.col("kind"), F.shiftright("node", FANOUT_BITS))


def heights(rows: DataFrame) -> int:
    """Levels between the leaves and nodes 0 and -1, where ids that are shifted on do not change any more."""
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    k = 0
    while lo is not None and (hi >> FANOUT_BITS * k > 0 or lo >> FANOUT_BITS * k < -1):
        k += 1
    return k


def tree(rows: DataFrame, height: int) -> list[DataFrame]:
    """The levels of the tree over records ``rows``, leaves first, the root last; each is written and read for the next."""
    levels = [written(leaves(rows), "fixity-leaves")]
    for k in range(height + 1):  # a level has no more nodes than the one below
        levels.append(written(parents(levels[-1], k == height).coalesce(_parts(levels[-1])), "fixity-level"))
    return levels


def _parts(*levels: DataFrame) -> int:
    """Files for as many rows as ``levels`` have together: upper levels are small, and are not written in pieces."""
    return 1 + sum(x.count() for x in levels) // PER_FILE


def damaged_ids(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """(kind, id) of leaves that differ, found by descent from the root."""
    differ = None
    for k in range(len(first) - 1, -1, -1):
        a, b = (x.select("kind", "node", F.col("hash").alias(h)) for x, h in ((first[k], "ha"), (second[k], "hb")))
        if k < len(first) - 1:  # children of what differs on the level above
            keys = [x.alias(c) for x, c in zip(_up(k == len(first) - 2), ("up_kind", "up"), strict=True)]
            a, b = (x.select("*", *keys).join(differ, ["up_kind", "up"], "left_semi").drop("up_kind", "up") for x in (a, b))
        both = a.join(b, ["kind", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
        differ = both.select(F.col("kind").alias("up_kind"), F.col("node").alias("up")).coalesce(_parts(first[k], second[k]))
        differ = written(differ, "fixity-descent")
        if differ.isEmpty():
            break
    return differ.select(F.col("up_kind").alias("kind"), F.col("up").alias("id"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per record of either copy of pages: page_id, archive, record_offset, n_bytes, sha256, status."""
    ours, theirs = written(records(first), "fixity-first"), written(records(second), "fixity-second")
    height = max(heights(ours), heights(theirs))
    bad = written(damaged_ids(tree(ours, height), tree(theirs, height)), "fixity-damaged")
    # Records of ids that differ meet by content; an id with one record on either side is altered.
    by = ["kind", "id", "sha256"]
    a, b = (x.join(bad, ["kind", "id"], "left_semi") for x in (ours, theirs))
    both = a.select(*by, F.lit(True).alias("a")).join(b.select(*by, "archive", "n_bytes", F.lit(True).alias("b")), by, "full")
    odd = written(both.where("a is null or b is null"), "fixity-odd")
    counts = a.select("kind", "id", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("kind", "id", F.lit(0), F.lit(1)))
    single = counts.groupBy("kind", "id").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x = 1 and y = 1").select("kind", "id", F.lit(True).alias("single"))
    odd = odd.join(single, ["kind", "id"], "left")
    page_id = F.when(F.col("kind") == 1, F.col("id")).alias("page_id")
    lost = odd.where("b is null").select(*by, F.when(F.col("single"), "altered").otherwise("missing").alias("found"))
    own = with_offsets(ours).join(lost, by, "left").select(page_id, "archive", "record_offset", "n_bytes", "sha256", F.coalesce("found", F.lit("same")).alias("status"))
    extra = odd.where("a is null and single is null").select(page_id, "archive", F.lit(None).cast("long").alias("record_offset"), "n_bytes", "sha256", F.lit("extra").alias("status"))
    return own.union(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A copy of ``pages`` with damage that is easy to tell: by hash of the id, one page in 128 has its
    first byte changed, one in 256 is gone."""
    h = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(h.isin("3a", "b7"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), h.alias("h")).where("h <> '5c' or h is null").drop("h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a damaged copy."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


SQL = f"""
with r as (
  select distinct page_id, url, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as w
  from pages
)
select page_id, (page_id // {PER_ARCHIVE})::bigint as archive,
       coalesce(sum(octet_length(encode(w))) over (partition by page_id // {PER_ARCHIVE} order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as record_offset,
       octet_length(encode(w))::bigint as n_bytes, sha256(w) as sha256,
       case when substr(md5(page_id::varchar), 1, 2) = '5c' then 'missing'
            when substr(md5(page_id::varchar), 1, 2) in ('3a', 'b7') and left(html, 1) <> '#' then 'altered' else 'same' end as status
from r
"""
