"""Queries of the subpackage that SQL can express give the SQL's rows."""
import math

import duckdb
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 9)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_of_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql()[name]
    have = [c[0] for c in con.execute(f"select * from ({sql}) q limit 0").description]
    assert sorted(have) == sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in df.columns) + f" from ({sql}) q").fetchall()
    rows = lambda r: sorted((tuple(map(plain, x)) for x in r), key=repr)
    got = [tuple(r) for r in df.collect()]
    assert {tuple(type(v) for v in r if v is not None) for r in got} and rows(got) == rows(want)
