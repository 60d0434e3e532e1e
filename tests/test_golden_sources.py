"""Goldens (result files of the original project, copied under tests/fixtures)
and reader/writer behaviour."""
import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIX
from chatsieve.operators import runs as R
from chatsieve.sources import io as IO

RUNS = f"{FIX}/runs"


def test_run_table_csv_and_markdown_goldens(spark, tmpdir_path):
    s = IO.read_run_summaries(spark, f"{RUNS}/*/summary.json")
    t = R.order_runs(R.run_table(s))
    cols = [c for c in t.columns if c != "order"]
    gold = list(csv.reader(open(f"{RUNS}/run_table.csv", encoding="utf-8")))
    assert cols == gold[0]
    rows = R.as_text_columns(t.orderBy("order"), cols).collect()
    for g, r in zip(gold[1:], rows):
        for h, a, b in zip(cols, g, list(r)):
            if h == "path":
                assert a.rsplit("/", 1)[-1] == b.rsplit("/", 1)[-1]
            else:
                assert a == b, (h, a, b)
    md = [r.line for r in R.markdown_rows(t).orderBy("order").collect()]
    assert md == open(f"{RUNS}/run_table.md", encoding="utf-8").read().splitlines()
    # CSV writer round trip: Python's csv module reads back the same cells
    out = f"{tmpdir_path}/runs_csv"
    IO.write_csv(R.as_text_columns(t.orderBy("order"), cols), out)
    part = glob.glob(f"{out}/part-*.csv")[0]
    back = list(csv.reader(open(part, encoding="utf-8")))
    assert back[0] == gold[0]
    assert [x[:-1] for x in back[1:]] == [x[:-1] for x in gold[1:]]


def test_side_by_side_markdown_golden(spark, tmpdir_path):
    items = json.load(open(f"{FIX}/side_by_side/pairs.json", encoding="utf-8"))
    df = spark.createDataFrame(items, "id long, category string, question string, base_answer string, "
                                      "lora_answer string")
    blocks = R.side_by_side_markdown(df)
    out = f"{tmpdir_path}/md"
    IO.write_lines(blocks, out, text_col="block")
    text = open(glob.glob(f"{out}/part-*")[0], encoding="utf-8").read()
    assert text == open(f"{FIX}/side_by_side/report.md", encoding="utf-8").read()


def test_read_ordered_lines_references(spark):
    df = IO.read_ordered_lines(spark, f"{FIX}/reference_answers.txt")
    rows = df.orderBy("pos").collect()
    lines = [x.strip() for x in open(f"{FIX}/reference_answers.txt", encoding="utf-8") if x.strip()]
    assert len(rows) == len(lines) == 100
    assert [r.text for r in rows] == lines
    assert [r.pos for r in rows] == list(range(100))


def _stats(spark, path, metric):
    logs = IO.read_trainer_logs(spark, path)
    recs = R.log_records(logs)
    s = R.log_stats(R.log_series(recs, [metric]))
    return s.collect()[0]


@pytest.mark.parametrize("run,metric,count,first,last,mn", [
    ("sft_run/checkpoint-900", "loss", 90, 6.476979, 0.908777, 0.704412),
    ("sft_run/checkpoint-900", "eval_loss", 9, 2.104420, 1.844663, 1.732870),
    ("pref_500/checkpoint-63", "loss", 12, 0.625589, 0.116214, 0.084985),
    ("pref_beta01/checkpoint-250", "loss", 50, 0.642051, 0.002724, 0.001377),
    ("pref_beta03/checkpoint-250", "rewards/margins", 50, None, 12.287892, None),
])
def test_trainer_log_stats_goldens(spark, run, metric, count, first, last, mn):
    s = _stats(spark, f"{FIX}/logs/{run}/trainer_state.json", metric)
    assert s["count"] == count
    for got, exp in ((s["first"], first), (s["last"], last), (s["min"], mn)):
        if exp is not None:
            assert got == pytest.approx(exp, abs=5e-7)


def test_reward_series_and_flatten(spark):
    logs = IO.read_trainer_logs(spark, f"{FIX}/logs/pref_beta01/checkpoint-250/trainer_state.json")
    rs = R.reward_series(R.log_records(logs))
    last = {r.series: r.value for r in rs.where(F.col("step") == 250).collect()}
    assert last["rewards/accuracies"] == 1.0
    assert last["rewards/margins"] == pytest.approx(6.980091, abs=5e-7)
    s = IO.read_run_summaries(spark, f"{RUNS}/*/summary.json")
    flat = R.flatten_metrics(s)
    assert "eval_metrics__eval_loss" in flat.columns and "train_metrics__train_loss" in flat.columns


def test_running_peak_gb(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 5, 2, 5.5])],
                               "run int, step int, mem double")
    out = R.running_peak(df, ["run"], ["step"], "mem", scale=2.0, digits=4).orderBy("step").collect()
    assert [r.peak for r in out] == [1.5, 1.5, 2.5, 2.5, 2.75]


def test_order_runs_rank_fallback(spark):
    df = spark.createDataFrame([("b", "qk", "none", "x", "p1"), ("a", "qk", "none", "16", "p2"),
                                ("c", "all", "4bit", "4", "p3")],
                               "experiment string, target_preset string, quantization string, rank string, path string")
    o = [r.experiment for r in R.order_runs(df).orderBy("order").collect()]
    assert o == ["c", "a", "b"]


# ---------------------------------------------------------------- sources / sinks
def test_read_jsonl_blank_lines_and_failfast(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"id": 1, "output": "好"}\n\n   \n{"id": 2, "output": null}\n')
    df = IO.read_jsonl(spark, p, "id long, output string")
    assert sorted(r.id for r in df.collect()) == [1, 2]
    bad = os.path.join(tmpdir_path, "b.jsonl")
    with open(bad, "w") as f:
        f.write('{"id": 1}\n{oops\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, bad, "id long").collect()
    both = IO.read_named_splits(spark, {"train": p, "eval": p}, "id long, output string")
    assert sorted(r.split for r in both.select("split").distinct().collect()) == ["eval", "train"]


def test_write_jsonl_keeps_nulls_and_unicode(spark, tmpdir_path):
    df = spark.createDataFrame([(1, None, "退货")], "id long, category_correct int, q string")
    out = os.path.join(tmpdir_path, "pred")
    IO.write_jsonl(df, out)
    lines = [x for f in sorted(glob.glob(f"{out}/part-*.json"))
             for x in open(f, encoding="utf-8").read().splitlines() if x.strip()]
    assert len(lines) == 1
    line = lines[0]
    rec = json.loads(line)
    assert rec == {"id": 1, "category_correct": None, "q": "退货"}
    assert "退货" in line


def test_read_labelled_dialogues(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("1\t嗯 嗯\t因为 买二送 一\t没事\t客官 帮 您 看 了\n0\t问\t答\n\n")
    rows = IO.read_labelled_dialogues(spark, p).orderBy(F.desc("label")).collect()
    assert rows[0].label == 1 and rows[0].turns == ["嗯 嗯", "因为 买二送 一", "没事"]
    assert rows[0].reply == "客官 帮 您 看 了"
    assert rows[1].turns == ["问"] and rows[1].reply == "答"


def test_eval_summary_schema_golden(spark, tmpdir_path):
    """The summary written for a scored run has the original summary files' fields and types."""
    from chatsieve.operators import rules as RU
    items = spark.createDataFrame([(1, "c", "q", [["a"]], ["x"])],
                                  "id int, category string, question string, "
                                  "must_have_any array<array<string>>, forbidden array<string>")
    outs = spark.createDataFrame([(1, "a x")], "id int, output string")
    out = os.path.join(tmpdir_path, "s")
    IO.write_summary_json(RU.eval_summary(RU.score_outputs(items, outs, True), True), out)
    mine = json.loads(open(glob.glob(f"{out}/part-*.json")[0], encoding="utf-8").read())
    files = glob.glob(f"{FIX}/summaries/*.summary.json")
    assert len(files) == 6
    for f in files:
        gold = json.load(open(f, encoding="utf-8"))
        assert list(gold) == list(mine)
        assert {k: type(v) for k, v in gold.items()} == {k: type(v) for k, v in mine.items()} or \
            all(isinstance(mine[k], (int, float)) == isinstance(v, (int, float)) for k, v in gold.items())


def test_malformed_lines_go_to_the_quarantine(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "x.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"a": 1}\n{"a": \n{"a": 3}\nnot json\n')
    for schema in (None, "a long"):
        good, bad = IO.split_corrupt(IO.read_jsonl(spark, path, schema, strict=False))
        assert sorted(r["a"] for r in good.collect()) == [1, 3]
        assert sorted(r["line"] for r in bad.collect()) == ["not json", '{"a": ']
