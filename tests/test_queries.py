"""Every registered query against its SQL twin at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    want = cur.fetchall()
    columns = [d[0] for d in cur.description]
    kinds = {d[0]: check.KIND.get(str(d[1]), str(d[1])) for d in cur.description}
    assert dict(df.dtypes) == kinds
    order = sorted(columns)

    def ordered(table, names):
        at = [names.index(c) for c in order]
        return sorted(tuple(check.plain(r[i]) for i in at) for r in table)

    assert ordered(rows, df.columns) == ordered(want, columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_stable_schema(spark):
    df = entry_points.entry(spark)
    assert df.columns[:3] == ["risk_label", "risk_min", "risk_max"]
    assert df.count() == 5
