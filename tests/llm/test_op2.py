import random
from fractions import Fraction

import pytest

from tidewright.llm import op2_jaccard_join
from tidewright.llm.op2_jaccard_join import deduplicated, jaccard_groups
from tidewright.llm.shared import written

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {(d, len(sets[d]), find(d)) for d in ids}


def near_rows(seed, n, sizes):
    """Groups of near copies at all distances around the threshold, and a passage shared by many."""
    r = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(30)]
    while len(rows) < n:
        base = [f"w{r.randrange(400)}" for _ in range(r.choice(sizes))]
        for _ in range(r.choice([1, 2, 8])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.2:
                w += passage
            if r.random() < 0.1:
                w = w[: r.randrange(len(w) + 1)]
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize(("k", "t", "sizes"), [(3, Fraction(9, 10), [3, 9, 12, 22, 30, 60, 150]), (5, Fraction(4, 5), [5, 12, 40, 120, 300])])
def test_groups_equal_brute_force(spark, k, t, sizes):
    rows = near_rows(5, 400, sizes)
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), k, t)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, k, t.numerator, t.denominator)


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    """Near copies of which many are no copies of each other, in cells of a few sets; rows of cells stay few."""
    monkeypatch.setattr(op2_jaccard_join, "CELL", 16)
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for n in range(200):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        rows.append((n, " ".join(w)))
    made = []
    monkeypatch.setattr(op2_jaccard_join, "written", lambda df, tag: made.append((tag, out := written(df, tag))) or out)
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), 5, Fraction(4, 5))
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got.collect()} == brute(rows, 5, 4, 5)
    across = [df for tag, df in made if tag == "jaccard-across"]
    assert all(df.count() < 2000 for df in across)


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a + " more")]
    assert sorted(tuple(r) for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, a), (1, b)]


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, " \n"), (4, "A b\tc d"), (5, "a b c d"), (5, "a b c d"), (6, "x"), (7, "X"), (8, "x y")]
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as component_id", "2 as node"), 3, Fraction(9, 10))
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    want = [(None, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8)]
    assert out == sorted(want, key=str)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'n' as node")
    assert sorted(str(r.doc_id) for r in deduplicated(docs).collect()) == ["1", "2", "3", "4", "6", "8", "None"]


def test_empty_table(spark):
    assert jaccard_groups(spark.createDataFrame([], SCHEMA), 3, Fraction(9, 10)).count() == 0
