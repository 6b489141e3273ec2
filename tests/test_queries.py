"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got.select(*columns).collect()) == shown(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_name_with_sql_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_phone_format_of_large_keys(spark, tmp_path):
    keys = [1, 105_213, 105_214, 900_000, 200_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: (r.phone, r.valid) for r in entry.queries()["phone_format"](spark, str(tmp_path)).collect()}
    for k in keys:
        q = str(7919 * k**3)
        p = q[:11]
        assert got[k] == (f"({p[:2]}) {p[2:7]}-{p[7:]}" if len(p) > 7 else f"({p[:2]}) {p[2:]}", 10 <= len(q) <= 11)
