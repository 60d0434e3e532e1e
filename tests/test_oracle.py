"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import os

import pytest

from conftest import SF_SMALL, needs

import __spark_entry__ as E
from chatsieve.plans import registry
from tools.oracle_check import TABLES, table_hash, type_mismatches

NAMES = list(registry())  # optional operators are tested beside them
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs(SF_SMALL)
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows, "a query without an oracle must still return rows"
        return
    rel = duck.sql(SQL[name])
    assert not type_mismatches(df.dtypes, rel.columns, rel.types)
    res = duck.execute(SQL[name])
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(d_cols)
    assert len(rows) == len(d_rows)
    assert table_hash(df.columns, rows)[0] == table_hash(d_cols, d_rows)[0]


@needs(SF_SMALL)
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_rule_score" in df.columns
