import random

import pytest

from tidewright.llm import op7_sharding as d

SCHEMA = "doc_id long, text string"


def brute(spark, rows, limit):
    """Splits buckets on one more bit until they fit, from the rows' own hashes."""
    frame = spark.createDataFrame(rows, SCHEMA)
    h = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", d.hash60(frame.doc_id, frame.text).alias("h")).collect()}
    out, todo = {}, [("", [(h[r], len((r[1] or "").encode()), r) for r in rows])]
    while todo:
        bits, own = todo.pop()
        if sum(n for _, n, _ in own) <= limit or len({x for x, _, _ in own}) == 1:
            for _, _, r in own:
                out[r] = (bits, sum(n for _, n, _ in own), len(own))
            continue
        for bit in "01":
            part = [x for x in own if f"{x[0]:060b}"[len(bits)] == bit]
            if part:
                todo.append((bits + bit, part))
    return out


@pytest.mark.parametrize("limit", [1, 700, 5000, 10**9])
def test_equals_splitting(spark, limit):
    r = random.Random(2)
    rows = [(i, "x" * r.choice([0, 3, 50, 400])) for i in range(150)] + [(500, None), (None, "abc"), (501, "y" * 9000), (7, "other")]
    got = d.shard(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as shard_id", "1 as depth").repartition(3), limit).collect()
    want = brute(spark, rows, limit)
    assert {(x.doc_id, x.text): (x.shard_id, x.shard_bytes, x.shard_docs) for x in got} == want
    assert all(x.depth == len(x.shard_id) and (x.shard_bytes <= limit or x.shard_docs == 1) for x in got)


def test_equal_rows_go_into_chains_and_empty(spark):
    rows = [(1, "a" * 10)] * 25 + [(2, "b")]
    got = d.shard(spark.createDataFrame(rows, SCHEMA).repartition(2), 40).collect()
    sizes = {}
    for x in got:
        sizes[x.shard_id] = sizes.get(x.shard_id, 0) + x.n_bytes
    assert len(got) == 26 and max(sizes.values()) <= 40
    assert all(sizes[x.shard_id] == x.shard_bytes for x in got)
    assert d.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        d.shard(spark.createDataFrame(rows, SCHEMA), 0)
