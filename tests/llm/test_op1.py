import pytest

from tidewright.llm import op1_fixity as f

SCHEMA = "page_id long, url string, html string"


def audit(spark, a, b):
    out = f.audit(spark.createDataFrame(a, SCHEMA).selectExpr("*", "1 as archive", "2 as kind"), spark.createDataFrame(b, SCHEMA)).collect()
    return sorted(((r.page_id, r.status) for r in out), key=str), out


def test_every_kind_of_damage_is_located(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(0, 2200, 7)]
    copy = [(i, u, h + "!" if i in (70, 2100) else h) for i, u, h in pages if i not in (7, 1400)] + [(5, "http://new", "x")]
    got, out = audit(spark, pages, copy)
    want = {70: "altered", 2100: "altered", 7: "missing", 1400: "missing", 5: "extra"}
    assert got == sorted([(i, want.get(i, "same")) for i, _, _ in [*pages, (5, "", "")]], key=str)
    at = {}
    for r in sorted((r for r in out if r.status != "extra"), key=lambda r: r.page_id):
        assert r.record_offset == at.get(r.archive, 0)
        at[r.archive] = r.record_offset + r.n_bytes


def test_only_children_of_differing_nodes_differ(spark):
    """One altered record changes its path to the root; a missing one changes no hash of what follows it."""
    pages = [(i, "u", str(i)) for i in range(600)]
    trees = []
    for html, gone in (("300", None), ("x", None), ("300", 300)):
        rows = f.records(spark.createDataFrame([(i, u, html if i == 300 else h) for i, u, h in pages if i != gone], SCHEMA))
        trees.append(f.tree(rows, f.heights(rows)))
    for other in trees[1:]:
        differ = {(k, r.node) for k, (a, b) in enumerate(zip(trees[0], other, strict=True)) for r in a.join(b.withColumnRenamed("hash", "h"), ["kind", "node"]).where("hash <> h").collect()}
        assert differ - {(0, 300)} == {(1, 18), (2, 1), (3, 0), (4, 0)}
        assert [tuple(r) for r in f.damaged_ids(trees[0], other).collect()] == [(1, 300)]


@pytest.mark.parametrize("ids", [(None, -1), (-1, 0, 900), (None, -5000, 3, 1 << 40)])
def test_null_and_negative_ids(spark, ids):
    pages = [(i, "u", f"page {i}") for i in ids]
    copy = [(i, u, h + "!" * (k == 0)) for k, (i, u, h) in enumerate(pages[:-1])]
    want = [(ids[0], "altered"), *[(i, "same") for i in ids[1:-1]], (ids[-1], "missing")]
    assert audit(spark, pages, copy)[0] == sorted(want, key=str)


def test_nulls_repeats_and_empty(spark):
    pages = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "x" * 200000), (2, "u", "other")]
    got, _ = audit(spark, pages, [(None, None, None), (1, None, ""), (2, "u", "x" * 200000), (2, "u", "other")])
    assert got == sorted([(None, "same"), (1, "same"), (2, "same"), (2, "same")], key=str)
    assert audit(spark, [], [])[0] == []


def test_one_id_with_many_records(spark, monkeypatch):
    """Many records without an id, and of one id: offsets go on through the steps, and content tells what is damaged."""
    monkeypatch.setattr(f, "PER_STEP", 16)
    pages = [(None, "u", f"n{i}") for i in range(100)] + [(4, "u", f"m{i}") for i in range(100)] + [(5, "u", "one")]
    copy = [(i, u, {"n7": "N7", "m9": "M9"}.get(h, h)) for i, u, h in pages if h != "n8"]
    got, out = audit(spark, pages, copy)
    count = lambda i, s: sum(r == (i, s) for r in got)
    assert (count(None, "missing"), count(None, "extra"), count(None, "same")) == (2, 1, 98)
    assert (count(4, "missing"), count(4, "extra"), count(4, "same"), count(5, "same")) == (1, 1, 99, 1)
    for archive in (None, 0):
        rows = sorted((r for r in out if r.archive == archive and r.status != "extra"), key=lambda r: r.record_offset)
        assert [r.record_offset for r in rows] == [sum(x.n_bytes for x in rows[:k]) for k in range(len(rows))]
        ordered = [(r.page_id or 0, r.sha256) for r in rows]
        assert ordered == sorted(ordered)
