"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from sourcelore.queries import answers, base, code, facts, governance, ingest, packs, searching

MODULES = (base, searching, code, facts, packs, answers, governance, ingest)
CASES = [(m, n) for m in MODULES for n in m.ORACLES]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_equals_its_sql(spark, sf_dir, duck, module, name):
    df = module.QUERIES[name](spark, sf_dir)
    got = duck.execute(module.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in df.collect()) == want
