"""Selection by threshold against sorting."""
import math
import random

import pytest
from pyspark.sql import functions as F

from chatsieve.operators import dataset as DS
from chatsieve.operators import selection


def pick(rows, quotas):
    """rows: (id, group, key); the first by key (null and NaN last), then id."""
    out = []
    for g, q in quotas.items():
        own = sorted((math.inf if k is None or math.isnan(k) else k, i) for i, x, k in rows if x == g)
        out += [i for _, i in own[:q]]
    return sorted(out)


@pytest.mark.parametrize("few", [0, 1000])
def test_first_rows_of_groups_match_sorting(spark, monkeypatch, few):
    """Ties that hold most rows, infinities, tiny and huge keys, null keys and groups, quotas of none and of all."""
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    monkeypatch.setattr(selection, "BUCKETS", 4)
    rnd = random.Random(3)
    kinds = [lambda: 1.0, lambda: rnd.random(), lambda: float(rnd.randrange(3)), lambda: math.inf, lambda: -math.inf,
             lambda: None, lambda: float("nan"), lambda: 10.0 ** rnd.randint(-300, 300), lambda: -1.7e308, lambda: 0.0, lambda: -0.0]
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(kinds)()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, k double").repartition(5)
    for quotas in ({"a": 150, "b": 7, None: 30}, {"a": 1, "b": 10_000, "c": 0}):
        table = spark.createDataFrame(list(quotas.items()), "g string, quota long")
        out = selection.first_rows(df, "id", F.col("k"), ["id"], table, "g")
        assert out.columns == df.columns
        assert sorted(r["id"] for r in out.collect()) == pick(rows, quotas)


def test_half_a_table_and_edges(spark):
    df = spark.range(0, 9000, 1, 6).withColumn("score", (F.col("id") % 7).cast("double"))
    want = sorted(range(9000), key=lambda i: (-(i % 7), i))
    for k in (0, 1, 4500, 8999, 9000, 20_000):
        assert sorted(r["id"] for r in DS.quality_top_k(df, "score", k, "id").collect()) == sorted(want[:k]), k
    empty = df.where("id < 0")
    assert DS.quality_top_k(empty, "score", 5, "id").count() == 0 and DS.sample_rows(empty, 5, "id").count() == 0
    assert DS.sample_rows(df, 4000, "id").count() == 4000 and DS.sample_rows(df, None, "id") is df


def test_no_task_holds_the_selected_rows(spark):
    """Nothing of the plan gathers rows: no limit, and no window over more than ranks of partitions and buckets."""
    df = spark.range(0, 5000, 1, 4).withColumn("score", F.col("id") * 0.5)
    plan = DS.quality_top_k(df, "score", 2500, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan
