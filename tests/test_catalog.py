"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if not n.startswith("p") or not n[1:2].isdigit() or n.startswith("p4_"))


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def compare(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_guidance_keeps_the_sign_of_zero_and_takes_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.2916, 0.1, -1e-5, nan, inf, -0.0, 1e10]), (1, [0.1944, 0.1, 0.0, 1.0, inf, 0.0, -1e9]), (-1, [0.1, 0.2]), (-3, []), (2, None), (4, [1.0, None, 2.0]), (5, None), (2**62 + 1, [1.0]), (2**61, [2.0]), (None, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    signed = lambda rows: sorted(repr((r[0], r[1])) for r in rows)
    c = duckdb.connect()
    for folder, files in ((tmp_path, "embeddings.parquet/*.parquet"), ("/root/testdata/sf0.01", "embeddings.parquet")):
        c.execute(f"create or replace view embeddings as select * from '{folder}/{files}'")
        want = signed(c.execute(f"select vec_id, l from ({SQL['guidance_blend']})").fetchall())
        assert signed(QUERIES["guidance_blend"](spark, str(folder)).select("vec_id", "l").collect()) == want
        assert any("-0.0" in x for x in want)
