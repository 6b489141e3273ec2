import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewright.llm import op4_mixing as d

SCHEMA = "doc_id long, text string, source string, n_chars long"


def water(sizes, cap=3):
    """Targets by resharing what goes over the cap until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def rows_of(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["a", "a", "a", "B", "z", "é", None]) if i else "tiny"
        words = [f"w{i}.{k}" for k in range(r.randrange(0, 300))]
        out.append((i, r.choice([" ", "\n", " \t"]).join(words), s, 1))
    return out


def test_targets_and_words_taken(spark, monkeypatch):
    monkeypatch.setattr(d, "PER_BUCKET", 16)
    rows = rows_of(1) + [(900, None, "a", None), (901, " \n", "empty", 0), (902, "w " * 20000, "B", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    slots, pieces, sized = d.mix(docs)
    taken = {r.key: r.t for r in pieces.join(d._uses(slots), ["source_no", "block"]).groupBy("key").agg(d.F.sum(d.F.col("n_words") * d.F.col("uses")).alias("t")).collect()}
    size = {i: len(re.findall(d.WORD, t or "")) for i, t, _, _ in rows}
    per = Counter()
    for i, _, s, _ in rows:
        per[s] += size[i]
    want, got = water(per), Counter()
    for r in sized.collect():
        assert r.size == size[r.doc_id] and r.source_size == per[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert taken.get(r.key, 0) <= 3 * r.size
        got[r.source] += taken.get(r.key, 0)
    for s, t in want.items():
        assert abs(got[s] - t) <= 2 * d.BLOCK
    blocks = {(r.source_no, r.block): r.n for r in pieces.groupBy("source_no", "block").agg(d.F.sum("n_words").alias("n")).collect()}
    assert max(blocks.values()) == d.BLOCK
    assert sorted(map(tuple, slots.collect())) == sorted(map(tuple, d.mix(docs.repartition(5))[0].collect()))


def test_documents_of_the_mix(spark):
    rows = [*rows_of(3, 60), (5, "one two", "B", 7), (5, "one two", "B", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as block")
    out = d.mixed_documents(docs)
    assert out.columns == docs.columns
    text = {(i, w) for i, t, _, _ in rows for w in (t or "").split()}
    whole, per = {(i, t) for i, t, _, _ in rows}, Counter()
    for r in out.collect():
        assert all((r.doc_id, w) in text for w in r.text.split())
        assert (r.doc_id, r.text) in whole or r.n_chars == len(r.text)
        per[r.source] += len(r.text.split())
    want = water(Counter({s: sum(len(t.split()) for i, t, x, _ in {*rows} if x == s) for s in {x[2] for x in rows}}))
    assert all(abs(per[s] - t) <= 2 * d.BLOCK for s, t in want.items())


def test_empty_and_blank(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert d.mixed_documents(none).count() == 0 and d.mix(none)[0].count() == 0
    assert d.mixed_documents(spark.createDataFrame([(1, None, None, 0), (2, "", "a", 0)], SCHEMA)).count() == 0


def test_permutations_of_every_size(spark):
    """One to one and in range for every n up to 5,000, odd and even numbers of bits, and larger ones around a power of two."""
    bits = F.length(F.bin(F.col("n") - 1))
    sizes = spark.range(1, 5001).withColumnRenamed("id", "n").unionByName(spark.createDataFrame([(n,) for n in (16_384, 16_385, 32_768, 32_769, 100_003)], "n long"))
    rows = sizes.repartition(8).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = rows.select("n", d.permuted(F.col("x"), F.col("n"), bits, F.lit(5)).alias("y"))
    wrong = got.groupBy("n").agg(F.count_distinct("y").alias("k"), F.min("y").alias("a"), F.max("y").alias("b")).where("k <> n or a <> 0 or b <> n - 1")
    assert wrong.count() == 0


def test_every_slot_ends_on_a_block(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 90), "abc"[k % 3]) for k in range(3000)], "doc_id long, text string, source string")
    slots, pieces, _ = d.mix(docs, block=4)
    met = slots.join(pieces.select("source_no", "block").distinct(), ["source_no", "block"], "left_anti")
    assert slots.count() > 1000 and met.count() == 0
