"""Registered queries with SQL, and every native query's plan, on the smallest tables."""
import duckdb
import pytest

from chatsieve.llm import plans
from tools.oracle_check import table_hash, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = plans.QUERIES[name](spark, SF)
    rel = con.sql(plans.ORACLES[name])
    assert not type_mismatches(df.dtypes, rel.columns, rel.types)
    assert table_hash(df.columns, [tuple(r) for r in df.collect()])[0] == table_hash(rel.columns, rel.fetchall())[0]


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n.split("_")[0] in ("op3", "op4", "op5", "op8", "op9")])
def test_native_queries_run_no_python(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]
