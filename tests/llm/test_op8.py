import random

from tidewright.llm import op8_decontamination as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def prose(r, n, words):
    return " ".join(r.choices(words, k=n))


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, f"{prose(r, r.randrange(8, 60), words)}?\n{prose(r, r.randrange(2, 12), words)}.") for i in range(60)]
    docs, want = [], set()
    for n in range(150):
        text = prose(r, r.randrange(0, 700), words)
        if n % 3 == 0:
            i, t = r.choice(items)
            t = t.upper().replace("?", " ,;") if n % 2 else t
            cut = r.randrange(len(text) + 1)
            text = f"{text[:cut]}\n{t}\n{text[cut:]}"
            want.add((n, i))
        docs.append((n, text))
    docs, bench = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)
    got = d.matches(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.bm25 > 0 and x.question_overlap >= 0.6 for x in got)
    left = {x.doc_id for x in d.decontaminated(docs.selectExpr("1 as item_id", "*"), bench).collect()}
    assert left == set(range(150)) - {n for n, _ in want}


def test_bounds_leave_nothing_out(spark):
    """The search equals scoring every item against every passage."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, prose(r, r.randrange(3, 30), words)) for i in range(40)]
    index = d.Index(items)
    texts = [prose(r, r.randrange(0, 400), words) + " " + r.choice(items)[1] + prose(r, 30, words) for _ in range(60)]
    want = set()
    for n, t in enumerate(texts):
        w = d._hashes(t)
        for lo in range(0, len(w), index.stride):
            p = w[lo : lo + 2 * index.stride]
            for k, item in enumerate(index.items):
                terms, x, own = index.weights[k]
                score = x[np.isin(index.terms[terms], p)].sum()
                shares = d._shares(index.checks[k], p)
                if score >= d.SCORE and shares[0] >= d.QUESTION and shares[1] >= d.ANSWER:
                    want.add((n, item, round(float(score * own), 6)))
    got = {(n, i, round(s, 6)) for n, i, s, _, _ in index.search(pa.array(texts))}
    assert got == want and len(want) > 30


def test_odd_rows_parts_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "x y"), (4, "one two three four five")], ITEMS)
    rows = [(1, None), (2, ""), (3, "q alpha beta gamma delta q"), (3, "q alpha beta gamma delta q"), (None, "one two three four five"), (5, "z " * 200000 + "one two three four five")]
    docs = spark.createDataFrame(rows, DOCS)
    want = {(3, 1), (None, 4), (5, 4)}
    whole = sorted(map(str, d.matches(docs, bench).collect()))
    assert {(x.doc_id, x.item_id) for x in d.matches(docs, bench).collect()} == want
    monkeypatch.setattr(d, "PART_BYTES", 20)  # parts change no score and no passage
    assert sorted(map(str, d.matches(docs, bench).collect())) == whole
    assert d.decontaminated(docs, bench).count() == 2
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0
