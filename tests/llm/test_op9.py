import numpy as np

from tidewright.llm import op9_embedding_dedup as d

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    ok = {}
    for i, e in rows:
        if i is not None and e is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            ok[i] = np.asarray(e, np.float32).astype(float)
    ids = sorted(ok)
    links, root = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= d.LEAST:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in links}


def test_links_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 24))
    near = [x[k] + r.normal(size=24) * s for k in range(40) for s in (0.05, 0.2, 0.3, 0.4)]
    dense = [x[50] + r.normal(size=24) * 0.1 for _ in range(250)]
    same = [x[51]] * 30 + [x[51] * 2]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate([*x, *near, *dense, *same])]
    r.shuffle(rows)
    rows = [(int(i), e) for i, e in rows]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] + [1.0] * 23), (5005, [float("inf")] + [1.0] * 23), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as node").repartition(4)
    out = d.near_embeddings(docs, least_shards=3).collect()
    assert out[0].audited_links > 100 and out[0].audited_recall >= d.RECALL
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out}
    none = got.pop(None)
    assert none == (0, None, True)
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.98 * len(want)


def test_recall_with_planted_copies_among_many(spark):
    """10,000 vectors of which few have links: all searched in every shard, and the audit sees links."""
    r = np.random.default_rng(2)
    x = r.normal(size=(9000, 32)).astype(np.float32)
    y = (x[:1000] + r.normal(size=(1000, 32)) * r.choice([0.1, 0.3, 0.45], size=(1000, 1))).astype(np.float32)
    z = np.concatenate([x, y])
    u = z.astype(float) / np.linalg.norm(z.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= d.LEAST).sum(axis=1) - 1
    assert want.sum() > 1000
    rows = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(z)], SCHEMA).repartition(4)
    got = d.near_embeddings(rows).collect()
    n = np.zeros(len(z), int)
    for row in got:
        n[row.vec_id] = row.n_links
    assert (n <= want).all() and n.sum() >= 0.97 * want.sum()
    assert got[0].audited_links > 50 and got[0].audited_recall >= d.RECALL


def test_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted(tuple(x)[:4] for x in d.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert d.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.01]), (9, [0.0, -1.0])]
    got = sorted(tuple(x)[:4] for x in d.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True), (9, 0, 9, True)]


def test_beams_are_widened_before_a_scan():
    assert not d._scans(4 * d.BEAM, 10) and d._scans(16 * d.BEAM, 10) and not d._scans(16 * d.BEAM, 1 << 30)


def test_audit_holds_few_cosines_at_once(monkeypatch):
    r = np.random.default_rng(5)
    x = r.standard_normal((700, 16)).astype(np.float32)
    x[:200] = x[200:400] + np.float32(0.05) * r.standard_normal((200, 16)).astype(np.float32)
    g, nodes = d.Graph(x), np.arange(700)
    whole = d._audit(g, x, nodes, nodes)
    assert sum(len(t) for _, t in whole) >= 200
    sizes, unit = [], d._unit
    monkeypatch.setattr(d, "COSINES", 7000)
    monkeypatch.setattr(d, "_unit", lambda raw: sizes.append(len(raw)) or unit(raw))
    assert d._audit(g, x, nodes, nodes) == whole
    assert max(sizes) <= 10
