"""Plan guards: every registered query stays JVM-side and free of all-pairs joins."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, needs

import __spark_entry__ as E
from chatsieve.operators.clean import first_of_duplicates
from chatsieve.plans import registry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs(SF_SMALL)
@pytest.mark.parametrize("name", list(registry()))
def test_no_all_pairs_join_and_no_python(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not [f for f in FORBIDDEN if f in plan], plan


def test_dedup_aggregates_partially_before_shuffle(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)], "id long, t string")
    plan = _plan(first_of_duplicates(df, F.col("t"), "id"))
    assert "partial_min" in plan
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning")  # printed top-down
