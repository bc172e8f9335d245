"""Every registered query runs, and those with SQL agree with the oracle on the small tables."""

import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


def norm(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", CORE)
def test_agrees_with_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = QUERIES[name](spark, DIR)
    r = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(r.columns)
    ordered = lambda cols, rows: sorted(tuple(norm(v) for _, v in sorted(zip(cols, row))) for row in rows)
    assert ordered(df.columns, df.collect()) == ordered(r.columns, r.fetchall())


def test_entry(spark):
    if os.path.isdir(DIR):
        assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_upper_and_lower_read_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["fn_upper_lower_ascii"](spark, DIR).collect()}
    fold = lambda t, a, b: t if t is None else "".join(chr(ord(c) + b) if a <= c <= chr(ord(a) + 25) else c for c in t)
    assert any(len(t or "") > 60 for t in texts.values()) and got.keys() == texts.keys()
    assert all(got[i].u == fold(t, "a", -32) and got[i].l == fold(t, "A", 32) for i, t in texts.items())
