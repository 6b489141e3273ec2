import json

from pyspark.sql import functions as F

from tidewright.operators import collections as C
from tidewright.operators import corpus, feed, mutations
from tidewright.streaming import live

SUPPLIER = "id string, a string, b int"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_mutations(spark):
    base = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], SUPPLIER)
    patch = spark.createDataFrame([("2", None), ("3", "n")], "id string, a string")
    assert rows(mutations.patched(base, patch)) == [("1", "x", 1), ("2", None, 2)]
    assert rows(mutations.patched(base, patch, allowed=["b"])) == rows(base)
    merged = mutations.merged(base, patch)
    assert rows(merged) == [("1", "x", 1), ("2", None, 2), ("3", "n", None)]
    assert rows(mutations.merged(merged, patch)) == rows(merged)
    assert rows(mutations.replaced(base, patch)) == [("1", "x", 1), ("2", None, None), ("3", "n", None)]
    assert rows(mutations.deleted(base, patch)) == [("1", "x", 1)]
    one = spark.createDataFrame([("9", "new")], "id string, a string")
    assert rows(mutations.saved(base, one, None)) == [("1", "x", 1), ("2", "y", 2), ("9", "new", None)]
    assert rows(mutations.saved(base, one, "1")) == [("1", "new", 1), ("2", "y", 2)]
    prayed = spark.createDataFrame([("1", ["u"]), ("2", [])], "id string, prayedBy array<string>")
    assert rows(mutations.toggle_prayed(prayed, "1", "u")) == [("1", []), ("2", [])]


def test_collections_and_rules(spark):
    notes = spark.createDataFrame([("1", "u", 5), ("2", "v", 6), ("3", "u", 7)], "id string, authorId string, createdAt long")
    assert [r.id for r in C.notes(notes, "u").collect()] == ["3", "1"] and C.notes(notes, "").count() == 0
    prayers = spark.createDataFrame([("1", None, None, None, None, None)], C.SCHEMAS["oracoes"])
    assert C.prayers(prayers).first()[1:] == ("", "", "", [], 0)
    flags = C.prayer_flags(C.prayers(prayers), "").first()
    assert (flags.hasPrayed, flags.isOwner, flags.prayCount) == (False, True, 0)
    days = spark.createDataFrame([("1", "10/1"), ("2", "2/1"), ("3", "05/03"), ("4", "1/12")], "id string, date string")
    assert [r.date for r in C.agenda(days).collect()] == ["05/03", "1/12", "10/1", "2/1"]
    for collection, action, admin, want in [("anotacoes", "read", False, 2), ("oracoes", "read", False, 3), ("oracoes", "delete", False, 2), ("noticias", "read", False, 3), ("noticias", "write", False, 0), ("eventos", "write", True, 3)]:
        assert notes.where(C.may(collection, action, "u", admin)).count() == want
    assert notes.where(C.may("noticias", "read", None)).count() == 0
    assert notes.limit(0).isEmpty() and C.first_non_empty(notes.limit(0), notes).count() == 3 and C.first_non_empty(notes, notes).count() == 3
    users = spark.createDataFrame([("u", "a", "A@x", "1", "t", "data:1")], C.SCHEMAS["usuarios"])
    assert C.photo(users, "u").first()[0] == "data:1"
    assert C.admins(users, ["a@x"]).count() == 1 and C.admins(users, ["a@x"], fold=False).count() == 0


def test_corpus(spark):
    books = spark.createDataFrame([(0, "A", [["one JÓ", "two"], ["three jo"]]), (1, "B", [["jo four"]])], "book int, name string, chapters array<array<string>>")
    flat = corpus.flattened(books)
    hits = corpus.search(flat, " JO ", "book", "chapter", "verse")
    assert hits.count() == 0  # two characters are too few
    hits = corpus.named(corpus.search(flat, "jo four", "book"), books.select("book", F.lit("Dim").alias("name")).where("book = 0"))
    assert hits.select(corpus.reference(F.col("name"), F.col("chapter"), F.col("verse"))).first()[0] == "B 1:1"
    many = spark.range(200).select(F.col("id").alias("book"), F.lit("needle").alias("text"))
    assert [r.book for r in corpus.search(many, "NEEDLE", "book").collect()] == list(range(60))
    assert corpus.search(many.withColumn("text", F.lit("a%b")), "a_b", "book").count() == 0
    pages = corpus.chapters_of(spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "book int, chapters int"))
    near = {(r.book, r.chapter): (r.prev, r.next) for r in corpus.neighbours(pages, "book", "chapter").collect()}
    assert near == {(0, 0): (None, (0, 1)), (0, 1): ((0, 0), (2, 0)), (2, 0): ((0, 1), None)}


def test_feed(spark):
    entry = "<entry><yt:videoId>{}</yt:videoId>\n<title>{}</title><published>2024-01-01T00:00:00Z</published></entry>"
    xml = "<feed>" + entry.format("v2", "a &amp;lt; b") + entry.format("", "none") + entry.format("v1", "two\nlines") + "</feed>"
    got = feed.videos(spark.createDataFrame([(xml,)], "xml string")).orderBy("pos").collect()
    assert [(r.id, r.title) for r in got] == [("v2", "a < b"), ("v1", "")]
    assert got[0].url.endswith("watch?v=v2")


def test_live_snapshot_is_complete_after_each_change(spark, tmp_path):
    schema = "seq long, op string, id string, createdAt long"
    seen, source = [], tmp_path / "changes"
    source.mkdir()
    write = lambda n, xs: (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "id", "createdAt"), x))) for x in xs))  # noqa: E731, B905
    view = lambda df: C.ordered(df, "createdAt")
    def run():
        changes = spark.readStream.schema(schema).json(str(source))
        live.subscribe(changes, lambda df: seen.append([r.id for r in df.collect()]), view, str(tmp_path / "state")).awaitTermination(60)
    write(1, [(1, "set", "a", 10), (2, "set", "b", 20)])
    run()
    write(2, [(3, "delete", "a", None), (4, "set", "c", 15), (5, "set", "b", 5)])
    run()
    assert seen == [["b", "a"], ["c", "b"]]
    batch = live.latest(spark.read.schema(schema).json(str(source)))
    assert [r.id for r in view(batch).collect()] == seen[-1]


def test_a_stopped_subscription_delivers_no_more(spark, tmp_path):
    source, seen = tmp_path / "changes", []
    source.mkdir()
    changes = spark.readStream.schema("seq long, op string, id string").json(str(source))
    query = live.subscribe(changes, lambda df: seen.append(df.count()), lambda df: df, str(tmp_path / "state"), processingTime="1 second")
    (source / "1.json").write_text(json.dumps({"seq": 1, "op": "set", "id": "a"}))
    query.processAllAvailable()
    before = list(seen)
    query.stop()
    (source / "2.json").write_text(json.dumps({"seq": 2, "op": "set", "id": "b"}))
    assert before[-1] == 1 and not query.isActive and seen == before


def test_chapters_that_are_missing_keep_what_is_shown(spark):
    rows = spark.createDataFrame([(["a", "b"], c) for c in (0, 1, 2, -1, None)] + [(None, 0), ([], 0)], "chapters array<string>, c int")
    got = [r[0] for r in rows.select(corpus.chapter_or_kept(F.col("chapters"), F.col("c"), F.lit("kept"))).collect()]
    assert got == ["a", "b", "kept", "kept", "kept", "kept", "kept"]


def test_named_keeps_columns_of_its_own_names(spark):
    hits = spark.createDataFrame([(1, "own", "k", "n"), (2, "own", "k", "n"), (None, "own", "k", "n")], "book int, name string, _key string, _name string")
    names = spark.createDataFrame([(1, "Dim")], "book int, name string")
    assert rows(corpus.named(hits, names)) == sorted([(1, "Dim", "k", "n"), (2, "own", "k", "n"), (None, "own", "k", "n")], key=str)
