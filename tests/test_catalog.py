"""Every catalog query against its oracle."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 5)


def test_catalog(spark):
    import duckdb

    from tidelog.plans import catalog

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    sql, wrong = catalog.oracle_sql(), []
    for name, f in catalog.queries().items():
        df = f(spark, SF)
        got = df.collect()
        if name not in sql:
            continue
        rel = con.sql(sql[name])
        order = sorted(df.columns)
        key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
        want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=key)
        if sorted(rel.columns) != order or sorted((tuple(plain(r[c]) for c in order) for r in got), key=key) != want:
            wrong.append(name)
    assert not wrong
