import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.llm import op5_lm_scoring as lm

SCHEMA = "id long, text string"


def base(rows):
    toks = {i: [*(t or "").encode().lower().split(), 0] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    den = n + 0.5 * (v + 1)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / den) for w in ws)) for i, ws in toks.items()}


def scored(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", lm.held_out(F.col("id"))).repartition(3)
    model = lm.train(docs.where("not held_out").select("text"))
    return {r.id: r for r in lm.score(docs, model).collect()}, model


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(1000)] + [f"v{i}" for i in range(2000)]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(80)))) for i in range(400)]
    copies = [(400 + i, out[r.randrange(400)][1]) for i in range(100)]
    return out + copies + [(600, None), (601, ""), (602, " \n\t"), (603, "ÄB ab\x0bAB"), (604, "x" * 300000)]


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_base_is_exact_with_and_without_a_tail(spark, rows, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    got, model = scored(spark, rows)
    want = base(rows)
    assert set(got) == set(want)
    for i, (held, n, known, total, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, model.tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_model_beats_base_on_held_out_copies(spark, rows):
    got, _ = scored(spark, rows)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def low(c):
    """The lower end of a count's level: exact up to 8, then four levels an octave."""
    ends = sorted({*range(9), *(math.floor(8 * 2 ** (k / 4)) for k in range(1, 100))})
    return max(e for e in ends if e <= c)


def high(c):
    ends = sorted({*range(1, 9), *(math.floor(8 * 2 ** (k / 4)) for k in range(1, 100))})
    return min(e for e in ends if e > c) - 1 if c else 0


def defined_scores(rows):
    """Scores from their definition, with counts in dictionaries."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    toks = {i: [*(t or "").encode().lower().split(), 0] for i, t in rows}
    train = [ws for i, ws in toks.items() if not held[i]]
    one = Counter(w for ws in train for w in ws)
    count_of_context = one | Counter({"B": len(train)})  # as the filter has it: how often the word itself occurs
    two = Counter(p for ws in train for p in zip(["B", *ws[:-1]], ws, strict=True))
    after = Counter(u for u, _ in two)
    n1, n2 = (sum(c == k for c in two.values()) for k in (1, 2))
    d, n = n1 / (n1 + 2 * n2), sum(low(c) for c in one.values()) + 0.5 * (len(one) + 1)
    out = {}
    for i, ws in toks.items():
        p1 = [(low(one[w]) + 0.5) / n for w in ws]
        p2 = []
        for u, w, p in zip(["B", *ws[:-1]], ws, p1, strict=True):
            c, t = high(count_of_context[u]), low(after[u])
            p2.append(min(1.0, (max(low(two[u, w]) - d, 0) + d * t * p) / c) if c and t else p)
        mean = lambda *logs: (m := max(logs)) + math.log10(sum(10 ** (x - m) for x in logs) / len(logs))
        a, b = [math.log10(x) for x in p1], [math.log10(x) for x in p2]
        parts = sum(mean(sum(a[k : k + 64]), sum(b[k : k + 64])) for k in range(0, len(a), 64))
        out[i] = mean(sum(a), sum(b), sum(math.log10((x + y) / 2) for x, y in zip(p1, p2, strict=True)), parts)
    return out


@pytest.mark.parametrize("most_bits", [1 << 40, 0])
def test_score_equals_its_definition(spark, rows, monkeypatch, most_bits):
    """With bits enough for no false positives, broadcast and probed in its slices."""
    monkeypatch.setattr(lm, "BITS", 20_000)
    monkeypatch.setattr(lm, "MOST_BITS", most_bits)
    monkeypatch.setattr(lm, "UNIT", 1 << 10)
    got, model = scored(spark, rows)
    assert (model.filters is None) == (most_bits == 0)
    want = defined_scores(rows)
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], rel=1e-9), i
    plain = base(rows)
    assert all(r.base_score == pytest.approx(plain[i][4], rel=1e-9) for i, r in got.items())


def test_filter_finds_every_level_and_few_others():
    import numpy as np

    h = lm.mix(np.arange(1, 50001, dtype=np.uint64))
    q = lm.level(np.random.default_rng(0).zipf(1.6, 50000).clip(1, 10**6))
    own = lm.shard_of(h, 7)
    f = lm.Filter([lm.slice_of(h[own == k], q[own == k], lm.BITS) for k in range(7)])
    found = f.levels(h)
    assert (found >= q).all() and (found == q).mean() > 0.97
    assert (f.levels(lm.mix(np.arange(10**6, 10**6 + 50000, dtype=np.uint64))) > 0).mean() < 0.03


def test_repeats_and_empty_table(spark):
    got, _ = scored(spark, [(1, "a b"), (1, "a b"), (None, "a b c")])
    assert set(got) == {1, None}
    docs = spark.createDataFrame([], SCHEMA).withColumn("held_out", F.lit(False))
    assert lm.score(docs, lm.train(docs.select("text"))).count() == 0
