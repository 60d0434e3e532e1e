"""The streaming scorer gives the batch scorer's rows."""
import json
import os

from chatsieve.operators.rules import score_outputs
from chatsieve.streaming.scoring import prediction_stream, score_stream

ITEMS = [(1, "退换货场景", "q1", [["退货"], ["凭证"]], ["直接退款"]),
         (2, "物流查询场景", "q2", [["物流"]], [])]


def test_stream_matches_batch(spark, tmpdir_path):
    items = spark.createDataFrame(ITEMS, "id long, category string, question string, "
                                         "must_have_any array<array<string>>, forbidden array<string>")
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    preds = [{"run": "a", "id": 1, "output": "场景分类：退换货场景\n客服回复：提供凭证 退货"},
             {"run": "a", "id": 2, "output": "直接退款"},
             {"run": "b", "id": 1, "output": "无"}]
    for i, p in enumerate(preds):
        with open(os.path.join(src, f"p{i}.json"), "w", encoding="utf-8") as f:
            f.write(json.dumps(p, ensure_ascii=False) + "\n")
    stream = score_stream(prediction_stream(spark, src, max_files_per_trigger=1), items, True)
    q = (stream.writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.run, r.id, r.rule_score, r.risky) for r in spark.sql("SELECT * FROM scored_stream").collect())
    batch = score_outputs(items, spark.createDataFrame(preds, "run string, id long, output string"), True)
    exp = sorted((r.run, r.id, r.rule_score, r.risky) for r in batch.collect())
    assert got == exp and len(got) == 3


def test_start_scoring_writes_json(spark, tmpdir_path):
    from chatsieve.streaming.scoring import start_scoring
    items = spark.createDataFrame(ITEMS, "id long, category string, question string, "
                                         "must_have_any array<array<string>>, forbidden array<string>")
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "p.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"run": "a", "id": 1, "output": "凭证 退货"}, ensure_ascii=False) + "\n")
        f.write(json.dumps({"run": "a", "id": 2, "output": "物流"}, ensure_ascii=False) + "\n")
    out = os.path.join(tmpdir_path, "out")
    q = start_scoring(spark, src, items, out, os.path.join(tmpdir_path, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    rows = spark.read.json(out).select("id", "rule_score").orderBy("id").collect()
    assert [(r.id, r.rule_score) for r in rows] == [(1, 1.0), (2, 1.0)]
