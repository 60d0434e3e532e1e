"""Smaller operator contracts."""
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from chatsieve.operators import dataset as DS
from chatsieve.operators import metrics as M
from chatsieve.operators import rules as R
from chatsieve.operators import tokens as TK
from chatsieve.sources import io as IO


def test_tokenizer_udf_hook(spark):
    enc = TK.tokenizer_udf(lambda s: list(s.encode("utf-8")))
    df = spark.createDataFrame([("aé",), (None,)], "t string")
    got = [r.ids for r in df.select(enc("t").alias("ids")).collect()]
    assert got == [[97, 195, 169], None]
    seq = TK.masked_sequence(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), 2)
    r = spark.range(1).select(*[v.alias(k) for k, v in seq.items()]).collect()[0]
    assert (r.input_ids, r.labels, r.attention_mask) == ([1, 2], [-100, -100], [1, 1])


def test_bertscore_weights(spark):
    rows = [(0, "cand", "c0", [1.0, 0.0], 1.0), (0, "cand", "cls", [0.0, 1.0], 0.0),
            (0, "ref", "r0", [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "sid int, side string, tok string, vec array<double>, weight double")
    r = M.bertscore(df).collect()[0]
    assert r.precision == pytest.approx(1.0) and r.recall == pytest.approx(1.0)
    r2 = M.bertscore(df.drop("weight"), weight=None).collect()[0]
    assert r2.precision == pytest.approx(0.5)


def test_write_summary_json(spark, tmpdir_path):
    items = spark.createDataFrame([(1, "c", "q", [["a"]], [])],
                                  "id int, category string, question string, must_have_any array<array<string>>, "
                                  "forbidden array<string>")
    outs = spark.createDataFrame([(1, "a")], "id int, output string")
    s = R.eval_summary(R.score_outputs(items, outs, True), True)
    out = os.path.join(tmpdir_path, "summary")
    IO.write_summary_json(s, out)
    rec = json.loads(open(glob.glob(f"{out}/part-*.json")[0], encoding="utf-8").read())
    assert rec == {"num_samples": 1, "avg_rule_score": 1.0, "risky_response_rate": 0.0,
                   "use_gold_category": True}


def test_stratum_quotas_floors_and_total(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 50), ("c", 10), ("d", 3)], "s string, n long")
    q = {r.s: r.quota for r in DS.stratum_quotas(counts, 100, "s", "n", floors={"c": 20, "d": 2}).collect()}
    assert sum(q.values()) == 100
    assert q["c"] == 10 and q["d"] >= 2
    q2 = {r.s: r.quota for r in DS.stratum_quotas(counts, 5000, "s", "n").collect()}
    assert q2 == {"a": 1000, "b": 50, "c": 10, "d": 3}


def test_eval_summary_by_sets_add_up(spark):
    rows = [("r1", "x", 1.0, 0), ("r1", "y", 0.0, 1), ("r2", "x", 0.5, 0)]
    df = spark.createDataFrame(rows, "run string, category string, rule_score double, risky int")
    s = R.eval_summary_by(df, by=["run", "category"], sets=[["run"], ["run", "category"]]).collect()
    per_run = {r.run: r.num_samples for r in s if r.category is None}
    per_cat = {}
    for r in s:
        if r.category is not None:
            per_cat[r.run] = per_cat.get(r.run, 0) + r.num_samples
    assert per_run == per_cat == {"r1": 2, "r2": 1}


def test_classify_rule_order(spark):
    df = spark.createDataFrame([("物流 退货",), ("nothing",)], "t string")
    got = [r.c for r in df.select(DS.classify("t", [("退换货场景", ["退货"]), ("物流查询场景", ["物流"])]).alias("c")).collect()]
    assert got == ["退换货场景", "其他咨询场景"]


def test_pair_stats_maps(spark):
    from chatsieve.operators import preference as P
    df = spark.createDataFrame([("a", "infer", "high"), ("a", "given", "low"), ("b", "infer", "high")],
                               "category string, prompt_type string, risk_level string")
    maps = {r.dimension: r.counts for r in P.pair_stats_maps(P.pair_stats(df)).collect()}
    assert maps == {"category": {"a": 2, "b": 1}, "prompt_type": {"infer": 2, "given": 1},
                    "risk_level": {"high": 2, "low": 1}}


def test_split_exact_without_strata(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = DS.split_train_eval_exact(df, "k", 0.1, seed=3)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"eval": 100, "train": 900}


def test_augment_keeps_provenance(spark):
    base = spark.createDataFrame([("q", "a")], "question string, answer string")
    tpl = spark.createDataFrame([("x", "问{slot}", "答{slot}")], "k string, question_template string, answer_template string")
    slots = spark.createDataFrame([("x", "一"), ("x", "二"), ("y", "三")], "k string, slot string")
    rows = sorted(tuple(r) for r in DS.augment(base, tpl, slots, on="k").collect())
    assert rows == [("q", "a", "raw_cleaned"), ("问一", "答一", "rule_augmented"), ("问二", "答二", "rule_augmented")]


def test_py_float_str_matches_python_repr(spark):
    """Python ``str(float)`` for 320 values over 26 decades.  (Java 17 prints
    the smallest subnormal as 4.9E-324; that single value is left out.)"""
    import random
    from chatsieve.functions.format import py_float_str
    rnd = random.Random(1)
    vals = [5e-05, 1.0, 2.732290267944336, 1987.6185228824615, 1e7, 12345678.9, 1e16, 1.5e-7, -0.0001, 0.001,
            123.0, 2.7532596496809984e+16, 0.0, -3.25e-5, 0.00012345678901234567, 9999999999999998.0, 1e-4,
            9.99e-5, -0.0, 1.7976931348623157e308, 123456789012345.67, float("nan")]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 18) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(py_float_str("x").alias("s")).collect()]
    assert got == [str(v) for v in vals]
