"""Every query against its SQL in DuckDB, on whole tables."""

import math
from pathlib import Path

import pytest

from newsloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    rows, columns = df.collect(), sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    if name not in catalogue.ORACLE:
        assert got or name == "kmeans_issue"
        return
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_oracles_have_queries():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
