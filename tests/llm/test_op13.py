import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewright.llm import op13_periodic_runs as op13


def slow(w):
    """Runs by their definition: for each period, the longest stretches of equal words p apart."""
    out, n = [], len(w)
    for p in range(1, n // 4 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and w[e] == w[e + p]:
                e += 1
            seg = w[s : e + p]
            if e > s and len(seg) >= max(6, 4 * p) and not any(all(seg[i] == seg[i + q] for i in range(len(seg) - q)) for q in range(1, p)):
                out.append((s, len(seg), p))
            s = max(e, s + 1)
    return sorted(out)


def collapsed(w, found):
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 2) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, 9)
        w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("rounds", [1, 8])
def test_runs_are_those_of_the_definition(monkeypatch, rounds):
    monkeypatch.setattr(op13, "ROUNDS", rounds)
    rng = random.Random(5)
    texts = [some_words(rng) for _ in range(1500)]
    found = list(op13.searched([" ".join(w).encode() for w in texts]))
    for w, (runs, kept) in zip(texts, found, strict=True):
        assert runs == slow(w) == op13.periodic(w)
        assert kept.decode() == collapsed(w, slow(w))


def test_squares_have_their_smallest_period():
    assert op13.squares(list("abababab"))[0, 2] == 7
    assert {p for _, p in op13.squares([1] * 50)} == {1}


def test_cuts_keep_every_run():
    rng = random.Random(6)
    for _ in range(300):
        w = some_words(rng)
        ids = np.array([int(x[1:]) for x in w], np.int64)
        inside = list(op13.stretches(ids, np.array([0, len(w)])))
        assert all(any(a <= s and s + m <= b for a, b in inside) for s, m, _ in slow(w))


def test_rows_of_every_kind(spark):
    rng = random.Random(8)
    long = [f"x{rng.randrange(2000)}" for _ in range(60_000)]
    long[20_000:50_000] = [long[20_000 + i % 3001] for i in range(30_000)]
    texts = [None, "", "  \t\n", "a a a a a", "a\x0ba\na\ra\ta a", "a a a a a a", "same same same same same same same", "A a A a A a A a", "ü\xa0ü ü\xa0ü ü\xa0ü ü\xa0ü ü\xa0ü ü\xa0ü", " ".join(long)]
    rows = [(k if k != 3 else None, x, 1, "c") for k, x in enumerate(texts)] + [(6, texts[6], 1, "c")]
    got = op13.with_runs(spark.createDataFrame(rows, "doc_id long, text string, Runs long, collapsed string"))
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        w = [x.decode() for x in (r.text or "").encode().split()]
        want = slow(w) if len(w) < 1000 else [(20_000, 30_000, 3001)]
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(w, want)
    assert op13.with_runs(got.select("doc_id", "text").limit(0)).count() == 0


def expected(doc_id, text):
    w, h = [x.decode() for x in (text or "").encode().split()], zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = op13.periodic(w)  # equal to the definition by the tests above
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(collapsed(w, found)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = sorted(tuple(r) for r in op13.query(spark, folder).collect())
    assert got == sorted(expected(*x) for x in texts.items())
    assert any(r[1] for r in got)
