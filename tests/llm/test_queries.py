"""The registered queries: columns and types, no row twice, and their SQL where there is any."""

from pathlib import Path

import pytest

from newsloom.llm import queries

SCHEMAS = {
    "p1_found": "struct<news_a:int,news_b:int>",
    "p2_found": "struct<company_id:int,line:string>",
    "p3_found": "struct<name_a:string,name_b:string>",
    "p4_found": "struct<news_id:int,end_pos:int>",
    "p5_found": "struct<news_id:int,field:string>",
    "p6_found": "struct<idx:int,line_md5:string>",
    "p7_found": "struct<news_id:int,cluster_id:int>",
    "p9_found": "struct<doc_id:bigint,item_id:bigint>",
    "p10_found": "struct<doc_a:bigint,doc_b:bigint>",
}
PAIRS = {"p1_found", "p3_found", "p10_found"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in SCHEMAS:
        assert df.schema.simpleString() == SCHEMAS[name]
    if name in PAIRS:
        assert all(a < b for a, b in rows)
    if name not in queries.ORACLE:
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(queries.ORACLE[name])
    order = [[d[0] for d in result.description].index(c) for c in df.columns]
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_each_problem_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"p{n}" for n in range(1, 11)}
