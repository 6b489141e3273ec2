"""The pipeline's stages, each on what the one before keeps."""

import corpus_pipeline as p
from tidewright.llm import op4_mixing, op8_decontamination
from tidewright.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES:
        before, out = docs, p.written(stage(spark, docs, FOLDER), "test")
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and now
        if name != "sharding":
            assert out.columns == columns
        if name == "n-gram Jaccard join":
            assert out.select("text").distinct().count() == out.count()
        if name == "benchmark decontamination":
            assert op8_decontamination.matches(out, table(spark, FOLDER, "benchmark")).isEmpty()
        if name == "mixing sources to target weights":
            words = lambda df: df.select(op4_mixing.F.sum(op4_mixing.n_words(df.text))).first()[0]
            assert abs(words(out) - words(before)) < 0.05 * words(before)
        if name == "sharding":
            assert out.count() == before.count() and "shard_id" in out.columns
        docs, ids = out, now
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5


ODD = "doc_id long, text string, lang string, source string, n_chars long, key long, _key string, keep boolean, row long, shard_id string, gram long"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeats and ties, and columns named like those the stages make."""
    clean = "the quiet river runs past the old mill and the children watch the boats go by until the evening comes"
    texts = [None, "", " ", "x", clean, clean, clean + " again", "word " * 40_000, "ünï ✓ 漢字 " * 50, "\x00\x01 zero"]
    rows = [(n, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, n, "k", True, n, "s", n) for n, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, clean + " without an id", None, None, None, *[None] * 6)], ODD).repartition(3)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(n, None if n == 1 else n % 2, None if n == 2 else 0) for n in range(6)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = "item_id long, text string"
    spark.createDataFrame([(1, None), (None, ""), (2, "which of the seven planets has the most moons of all")], items).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs(spark)
    given = [tuple(r) for r in docs.collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        of = {r[0] for r in given}
        assert {r.doc_id for r in rows} <= of, name
        if name != "sharding":
            assert out.columns == docs.columns, name
            cut = {"text", "n_chars"} if name.startswith("mixing") else set()  # the mix may take a part of a text
            same = lambda r: tuple(v for c, v in zip(docs.columns, r, strict=True) if c not in cut)
            assert {same(r) for r in rows} <= {same(r) for r in given}, name
        if name in ("quality classifier", "benchmark decontamination"):
            assert {r.doc_id for r in rows} >= {0, 1}, name  # no text is no reason to go
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id in (4, 5, 6) for r in rows) == 1 and {r.doc_id for r in rows} >= {0, 1, 2, 3, 7, 8}
        if name == "sharding":
            assert len(rows) == len(given)
        assert not stage(spark, docs.limit(0), str(tmp_path)).count(), name
