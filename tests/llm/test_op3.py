import math
import random
import re
from collections import Counter

import pytest

from tidewright.llm import op3_quality as q

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int"


def model(texts, order):
    """Interpolated modified Kneser-Ney, from the definition."""
    counts = [None] * (order + 1)
    counts[order] = Counter(g for t in texts for g in grams(t, order))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = [None] * (order + 1)
    for k in range(1, order + 1):
        n = Counter(c for c in counts[k].values() if c <= 4)
        if not n[1] or not n[2]:
            disc[k] = [0.5, 0.75, 0.9]
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
        disc[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        same = [(c, disc[k][min(c, 3) - 1]) for x, c in counts[k].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        total = sum(c for c, _ in same)
        c = counts[k][g]
        own = c - disc[k][min(c, 3) - 1] if c else 0
        return own / total + sum(d for _, d in same) / total * p(g[1:])

    return p


def grams(text, order):
    b = b"\0" * (order - 1) + text.encode() + b"\0"
    return [b[i : i + order] for i in range(len(b) - order + 1)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_perplexity_equals_definition(spark, order):
    r = random.Random(1)
    texts = ["".join(r.choice("aabcdé \n") for _ in range(r.randrange(1, 40))) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    tables = q.train(frame.where("key < 6"), order)
    got = dict(q.perplexities(frame, tables).collect())
    p = model(texts[:6], order)
    for i, t in enumerate(texts):
        logs = [math.log(p(g)) for g in grams(t, order)]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)


def test_shuffled_and_broadcast_joins_agree(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "abcabcab"), (2, "abcd"), (3, "zzz")], "key long, text string")
    tables = q.train(frame.where("key = 1"))
    a = dict(q.perplexities(frame, tables).collect())
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    assert dict(q.perplexities(frame, tables).collect()) == pytest.approx(a)


def test_junk_goes_and_odd_rows_have_defined_results(spark):
    r = random.Random(2)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randrange(2, 8))) for _ in range(50)]
    clean = [(i, " ".join(r.choices(words, k=60)), "en") for i in range(60)]
    junk = [(100 + i, " ".join(w + "###|" for w in r.choices(words, k=60)), "en") for i in range(10)]
    odd = [(200, None, "en"), (201, "", None), (202, "aei " * 50, None), (None, clean[0][1], "en"), (203, "aei nrs", "xx"), (203, "aei nrs", "xx")]
    docs = spark.createDataFrame(clean + junk + odd, DOCS)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(40)] + [(0, 0), (None, 1)], LABELS)
    out = {str(x.doc_id): x for x in q.classify(docs, labels).collect()}
    assert all(out[str(i)].keep for i in range(60)) and not any(out[str(100 + i)].keep for i in range(10))
    assert out["200"].perplexity is None and out["200"].keep and out["201"].keep and out["None"].keep
    assert q.classify(docs, labels).count() == len(clean + junk + odd)
    stay = q.kept(docs.selectExpr("*", "1 as key", "2 as keep"), labels)
    assert stay.columns == ["doc_id", "text", "lang", "key", "keep"]
    assert {str(x.doc_id) for x in stay.collect()} == {k for k, x in out.items() if x.keep}


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", "en")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [x.keep for x in q.classify(docs, none).collect()] == [True]
    assert q.classify(docs.limit(0), none).count() == 0


def test_toxic_text_is_not_trusted_and_goes(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randrange(2, 8))) for _ in range(200)]
    prose = lambda: r.choices(words, k=80)
    clean = [(i, " ".join(prose()), "en") for i in range(200)]
    toxic = [(1000 + i, " ".join([*prose(), r.choice(["You idiot!", "STUPID scum.", "stupid idiot"])]), "en") for i in range(40)]
    docs = spark.createDataFrame(clean + toxic, DOCS)
    labels = [(i, 1, 0) for i in range(100)] + [(1000 + i, 1, 1) for i in range(20)] + [(1000, 1, 0)]
    out = q.classify(docs, spark.createDataFrame(labels, LABELS + ", toxic int")).collect()
    keep = {x.doc_id: x.keep for x in out}
    assert len(out) == len(keep) == 240
    assert not any(keep[i] for i, _, _ in toxic)
    assert sum(keep[i] for i, _, _ in clean) >= 190


def rank_value(values, quantile):
    return sorted(values)[max(math.ceil(quantile * len(values)), 1) - 1]


def test_quantiles_equal_sorting(spark):
    r = random.Random(5)
    groups = {"en": [r.lognormvariate(2, 1) for _ in range(3000)], "de": [0.0] * 50, None: [float(r.randrange(4)) for _ in range(777)], "one": [7.5]}
    groups["near"] = [3 + i * 1e-12 for i in range(500)]
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "of string, value double")
    for quantile in (0.0, 0.37, 0.5, 0.99, 1.0):
        want = {g: rank_value(vs, quantile) for g, vs in groups.items()}
        assert {x.of: x.value for x in q.quantiles(rows.repartition(7), quantile).collect()} == want
    assert q.quantiles(rows.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("most", [q.BROADCAST_ROWS, 0])
def test_thresholds_and_keep_equal_definition(spark, monkeypatch, most):
    """Everything that decides, computed again from the definitions: perplexity, quantiles, telling words."""
    monkeypatch.setattr(q, "BROADCAST_ROWS", most)
    r = random.Random(6)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randrange(2, 6))) for _ in range(40)]
    docs, labels = [], []
    for i in range(90):
        text = r.choices(words, k=r.randrange(5, 15))
        if i % 9 == 0:
            text.append(r.choice(["Scum!", "scum, FOOL"]))
        if i % 10 == 1:
            text = ["#" + w + "|" for w in text]
        docs.append((i, " ".join(text), ("en", "de", None)[i % 3]))
        if i < 60:
            labels.append((i, int(i % 10 != 1), int(i % 9 == 0)))
    docs += [(90, None, "en"), (91, "", "de"), (92, docs[2][1], "xx"), (93, docs[2][1], "en"), (94, "zz qq " * 9, "xx")]
    labels += [(93, 1, 0), (2, 0, 0)]
    text, lang = {i: t for i, t, _ in docs}, {i: g for i, _, g in docs}
    bad = {text[i] for i, _, toxic in labels if toxic}
    trusted = [i for i in text if text[i] and text[i] not in bad and any(d == i and good and not toxic for d, good, toxic in labels)]
    p = model({text[i] for i in trusted}, 2)
    perplexity = {t: math.exp(-sum(math.log(p(g)) for g in grams(t, 2)) / len(grams(t, 2))) for t in set(text.values()) if t}
    tokens = lambda t: {w for w in re.split(r"[\x00-/:-`{-\x7f]+", t.lower()) if w}
    a, b = Counter(w for t in bad for w in tokens(t)), Counter(w for t in {text[i] for i in trusted} for w in tokens(t))
    n_a, n_b = len(bad), len({text[i] for i in trusted})

    def g2(w):
        if a[w] * n_b <= b[w] * n_a:
            return 0.0
        seen, share = [a[w], b[w], n_a - a[w], n_b - b[w]], (a[w] + b[w]) / (n_a + n_b)
        expected = [share * n_a, share * n_b, (1 - share) * n_a, (1 - share) * n_b]
        return 2 * sum(s * math.log(s / e) for s, e in zip(seen, expected, strict=True) if s)

    toxicity = lambda t: max((g2(w) for w in tokens(t)), default=0.0)
    quantile, slack = 0.9, 1.1
    most = rank_value([toxicity(text[i]) for i in trusted], quantile)
    out = q.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS + ", toxic int"), 2, quantile=quantile, slack=slack).collect()
    assert sorted(x.doc_id for x in out) == sorted(text)
    for x in out:
        same = [perplexity[text[i]] for i in trusted if lang[i] == x.lang] or [perplexity[text[i]] for i in trusted]
        assert x.threshold == pytest.approx(slack * rank_value(same, quantile))
        t = text[x.doc_id]
        if not t:
            assert x.keep and x.perplexity is None
        else:
            assert x.perplexity == pytest.approx(perplexity[t])
            assert x.keep == (perplexity[t] <= x.threshold and toxicity(t) <= most + 1e-9)
    assert {x.keep for x in out} == {True, False}


def test_text_longer_than_a_piece(spark):
    r = random.Random(7)
    text = "".join(r.choices("ab é", k=q.PIECE + 12_345))
    assert len(text.encode()) > q.PIECE
    rows = q.grams(spark.createDataFrame([(1, text)], "key long, text string"), 3).collect()
    got = Counter()
    for x in rows:
        got[x.gram.to_bytes(3, "big")] += x.n
    assert got == Counter(grams(text, 3))
