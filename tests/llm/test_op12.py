import hashlib
import random

import pytest
import sentencepiece

from tidewright.llm import op12_pieces as op12

FILE = op12.tokenizer_file()


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, "rb") as f:
        return op12.Encoder(op12.Merges(f.read()))


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_ids_are_the_librarys(lib, encoder):
    rng = random.Random(7)
    letters = [" ▁", " ab", "aeionst ", "the and\n.,", "日本語 éü", "  ab\t\n\x00\x0b", "😀 a\U0010ffff", "<0x41> <s>"]
    for _ in range(3000):
        some = rng.choice([*letters, "".join(rng.choice(encoder.m.texts[300:]) for _ in range(8)) + " "])
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 80)))
        want = lib.encode(text)
        assert encoder.ids(lib.normalize(text)) == want
        assert list(encoder.backwards(lib.normalize(text))) == want  # without cuts and memory


def test_every_prefix_has_the_last_piece_of_its_own_encoding(lib, encoder):
    text = lib.normalize("The   international    unbelievable ting.")
    for k in range(2, len(text) + 1):
        assert encoder.table(text)[k - 1] == encoder.backwards(text[:k])[-1]


def test_full_tables_change_no_result(lib, encoder, monkeypatch):
    monkeypatch.setattr(op12, "MEMO", 3)
    monkeypatch.setattr(op12, "PAIRS", 2)
    monkeypatch.setattr(op12, "STEPS", 2)
    small = op12.Encoder(encoder.m)
    text = "one two three four. five, six one two three four! " * 20
    assert small.ids(lib.normalize(text)) == lib.encode(text)


def test_rows_of_every_kind(spark, lib):
    long = "wordless" * 40_000 + " " + "日本" * 30_000 + " 	" * 2_000
    texts = [None, "", " ", "  two  spaces ", "same", "same", "a\nb\n", "▁", long]
    rows = [(k if k != 4 else None, x, "i", "d") for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded string")
    got = op12.encoded(docs, FILE)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    found = {r.doc_id: r for r in got.collect()}
    for k, x, *_ in rows:
        assert found[k].ids == lib.encode(x or "") and found[k].decoded == lib.decode(lib.encode(x or ""))
    assert op12.encoded(docs.limit(0), FILE).count() == 0


def test_query_digests(spark, lib):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12.query(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)))
