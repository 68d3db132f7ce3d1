"""Every query with SQL gives the SQL's rows, with columns of the same kind and exact integers."""
import datetime
import decimal

import duckdb
import pytest

from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float, decimal.Decimal)):
        return "number"
    return "time" if isinstance(v, (datetime.datetime, datetime.date)) else type(v).__name__


def exact(v):
    """Whole numbers as they are, others to nine digits; no number is a text."""
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime, datetime.date)):
        return repr(v)
    return repr(int(v)) if v == int(v) else f"{float(v):.9g}"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = registry.oracle_sql()[name]
    assert sorted(c[0] for c in con.execute(f"select * from ({sql}) q limit 0").description) == cols
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql}) q").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rows = lambda r: sorted(tuple(map(exact, x)) for x in r)
    kinds = lambda r: [{kind(x[i]) for x in r if x[i] is not None} for i in range(len(cols))]
    assert rows(got) == rows(want)
    assert kinds(got) == kinds(want)


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set()
