import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import op6_substring_dedup as d
from tidewright.llm.suffixes import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def brute(rows):
    first = {}
    key = lambda i: d.NO_ID if i is None else i
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, d.NO_ID), key(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard").repartition(4)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.deduplicated(frame).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "STEP", 1 << 10)
    monkeypatch.setattr(d, "SORTED", 1 << 12)
    r = random.Random(9)
    words = ["the", "of", "naïve", "été", "aa", "b", "straße", "x\0y", "."] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    shared = [prose(r.randrange(5, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [r.choice([prose(r.randrange(0, 30)), r.choice(shared), r.choice(shared)[: r.randrange(45, 60)]]) for _ in range(r.randrange(0, 6))]
        rows.append((i, r.choice(["", " ", "\n"]).join(parts)))
    rows += [(200, rows[5][1]), (201, "a" * 400), (202, "b" + "a" * 300), (203, "=" * 49), (204, "=" * 49), (205, "=" * 50), (206, "=" * 51), (207, None), (208, ""), (None, rows[6][1]), (None, rows[6][1]), (7, rows[7][1])]
    rows += [(210, prose(1500)), (211, rows[3][1] + prose(600) + rows[4][1])]
    r.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_one_line_in_all_documents_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(d, "PER_BUCKET", 1 << 12)
    r = random.Random(4)
    line = "this line of more than fifty bytes is in every document, word by word"
    rows = [(i, f"{r.random()} start {line} end {r.random()}\n{line}") for i in range(300)]
    rows.append((900, "\n".join(f"{r.random()} {line if k % 50 == 0 else ''}" for k in range(1500))))
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array_and_prefixes(alphabet):
    r = random.Random(alphabet)
    for _ in range(60):
        b = bytes(r.randrange(1, alphabet + 1) for _ in range(r.randrange(1, 120))) + b"\0"
        t = np.frombuffer(b, np.uint8)
        sa = suffix_array(t, 200)
        assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        p = permuted_common_prefixes(t, sa, 10)
        for x, y in zip(sa[1:], sa[:-1], strict=True):
            n = 0
            while n < 10 and max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert p[x] == n


def test_rows_of_one_id_or_none_lose_their_own_bytes_only(spark):
    a, b = ("".join(f"{c}{i} " for i in range(40)) for c in "xy")
    rows = [(1, a), (2, b), (None, "front " * 3 + a), (None, b + "tail"), (None, "clean " + "".join(f"z{i} " for i in range(80))), (7, a + "end"), (7, "".join(f"q{i} " for i in range(80)) + b)]
    assert got(spark, rows) == brute(rows)


def test_anchors_are_dealt_evenly():
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    batch = pa.record_batch([pa.array(range(40)), pa.array(texts), pa.array(range(40))], names=["doc_id", "text", "row"])
    sizes = {}
    for out in d._seen(64)(iter([batch])):
        for k, h in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            sizes[k] = sizes.get(k, 0) + len(h) // 8
    assert len(sizes) == 64
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 64
