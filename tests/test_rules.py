"""Rule scoring against plain-Python statements of the two scorers."""
import re

from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.operators import rules as R

CATS = D.CATEGORIES


def py_extract_category(text):
    """Category named after the first label that has text after it: skip
    whitespace (newlines too), take the rest of that line, trim it; the first
    known category inside wins, else its first 20 characters."""
    for label in re.finditer("场景分类[:：]", text):
        rest = text[label.end():].lstrip()
        if rest:
            line = re.split("[\n\r]", rest, maxsplit=1)[0].strip()
            known = [c for c in CATS if c in line]
            return known[0] if known else line[:20]
    return ""


def py_detail(item, output, gold_mode):
    compact = "".join(output.split())
    groups = item.get("must_have_any") or []

    def hit(group):
        return any(term in compact for term in (group or []) if term)

    missed = [g for g in groups if not hit(g)]
    hits = len(groups) - len(missed)
    forb = [term for term in (item.get("forbidden") or []) if term and term in compact]
    pred = py_extract_category(output)
    return {"pred_category": pred,
            "category_correct": None if gold_mode else int(pred == item["category"]),
            "must_hit_count": hits, "must_total": len(groups),
            "rule_score": hits / len(groups) if groups else 0.0,
            "missed_groups": missed, "forbidden_hits": forb, "risky": 1 if forb else 0}


def py_pass(item, output):
    groups = item.get("must_have_any") or []
    failing = [g for g in groups if not [k for k in g if k in output]]
    flagged = [k for k in (item.get("forbidden") or []) if k in output]
    return not failing, bool(flagged)


ITEMS = [
    {"id": 1, "category": "退换货场景", "question": "q1", "must_have_any": [["退货", "退款"], ["凭证"]],
     "forbidden": ["直接退款", ""]},
    {"id": 2, "category": "物流查询场景", "question": "q2", "must_have_any": [], "forbidden": []},
    {"id": 3, "category": "商品参数场景", "question": "q3", "must_have_any": [[""], [], ["详情 页"]],
     "forbidden": None},
    {"id": 4, "category": "其他咨询场景", "question": "q4", "must_have_any": None, "forbidden": ["😀"]},
    {"id": 5, "category": "质量投诉场景", "question": "q5", "must_have_any": [["照片"]], "forbidden": ["赔偿"]},
    {"id": 6, "category": "价格优惠场景", "question": "q6", "must_have_any": [["优惠"]], "forbidden": []},
]
OUTPUTS = {
    1: "场景分类：退换货场景\n客服回复：您好，请提供 凭证，我们 核实后 处理退货。直接 退款 不行",
    2: "场景分类:  物流查询场景 \n客服回复：正在查询",
    3: "场景分类：\n商品参数场景以详情页为准",
    4: "没有分类 😀",
    5: "场景分类：这是一个非常非常长的未知类别名字超过二十个字符的情况\n客服回复：请拍照片",
    6: "场景分类：　价格优惠场景\n客服回复：优惠以页面为准",
}


def _frames(spark):
    items = spark.createDataFrame(
        [(i["id"], i["category"], i["question"], i["must_have_any"], i["forbidden"]) for i in ITEMS],
        "id int, category string, question string, must_have_any array<array<string>>, forbidden array<string>")
    outs = spark.createDataFrame(list(OUTPUTS.items()), "id int, output string")
    return items, outs


def test_score_outputs_matches_python(spark):
    items, outs = _frames(spark)
    for gold in (True, False):
        got = {r.id: r for r in R.score_outputs(items, outs, gold).collect()}
        for it in ITEMS:
            exp = py_detail(it, OUTPUTS[it["id"]], gold)
            r = got[it["id"]]
            for k, v in exp.items():
                assert getattr(r, k) == v, (it["id"], k, getattr(r, k), v)
            assert r.risk_level == ""


def test_eval_summary(spark):
    items, outs = _frames(spark)
    sc = R.score_outputs(items, outs, False)
    s = R.eval_summary(sc, False).collect()[0]
    exps = [py_detail(i, OUTPUTS[i["id"]], False) for i in ITEMS]
    assert s.num_samples == len(ITEMS)
    assert abs(s.avg_rule_score - sum(e["rule_score"] for e in exps) / len(exps)) < 1e-12
    assert abs(s.risky_response_rate - sum(e["risky"] for e in exps) / len(exps)) < 1e-12
    assert abs(s.category_accuracy - sum(e["category_correct"] for e in exps) / len(exps)) < 1e-12
    empty = R.eval_summary(sc.where(F.lit(False)), True).collect()[0]
    assert empty.num_samples == 0 and empty.avg_rule_score is None


def test_rule_pass_rates_matches_python(spark):
    items, outs = _frames(spark)
    j = items.join(outs, "id").withColumn("output", F.trim("output"))
    got = R.rule_pass_rates(j).collect()[0]
    res = [py_pass(i, OUTPUTS[i["id"]].strip()) for i in ITEMS]
    # a null keyword list counts as empty (the Python statement would raise)
    assert abs(got.must_have_pass_rate - sum(a for a, _ in res) / len(res)) < 1e-12
    assert abs(got.forbidden_hit_rate - sum(b for _, b in res) / len(res)) < 1e-12


def test_extract_output_order_and_strict(spark):
    df = spark.createDataFrame([(None, " b ", "c"), ("a", None, None), (None, None, None)],
                               "output string, pred string, answer string")
    got = [r.output for r in R.extract_output(df).collect()]
    assert got == ["b", "a", None]
    import pytest
    with pytest.raises(Exception):
        R.extract_output(df, strict=True).collect()
    with pytest.raises(KeyError):
        R.extract_output(df.select(F.lit(1).alias("x")))


def test_scorers_on_random_rows(spark):
    """Randomised rows (emoji, full-width space, U+0085, empty keywords and
    groups, keywords with spaces) scored in one DataFrame vs Python."""
    import random
    rnd = random.Random(11)
    alphabet = ["退", "货", "凭", "证", "a", "b", " ", "　", "\u0085", "😀", "\n", "场景分类：", "："]
    words = ["退货", "凭证", "a b", "", "😀", "货凭", "b"]

    def text():
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))

    items, outs = [], {}
    for i in range(150):
        groups = [[rnd.choice(words) for _ in range(rnd.randint(0, 3))] for _ in range(rnd.randint(0, 3))]
        forb = [rnd.choice(words) for _ in range(rnd.randint(0, 2))]
        cat = rnd.choice(CATS)
        items.append({"id": i, "category": cat, "question": "q", "must_have_any": groups, "forbidden": forb})
        outs[i] = (f"场景分类：{rnd.choice(CATS)}" if rnd.random() < 0.3 else "") + text()
    idf = spark.createDataFrame(
        [(x["id"], x["category"], x["question"], x["must_have_any"], x["forbidden"]) for x in items],
        "id int, category string, question string, must_have_any array<array<string>>, forbidden array<string>")
    odf = spark.createDataFrame(list(outs.items()), "id int, output string")
    got = {r.id: r for r in R.score_outputs(idf, odf, False).collect()}
    for it in items:
        exp = py_detail(it, outs[it["id"]], False)
        for k, v in exp.items():
            assert getattr(got[it["id"]], k) == v, (it, outs[it["id"]], k)
    j = idf.join(odf, "id")
    flags = {r.id: (r.p, r.f) for r in j.select(
        "id", *[c.alias(n) for n, c in zip(("p", "f"), R.rule_pass_columns(
            F.col("output"), F.col("must_have_any"), F.col("forbidden")).values())]).collect()}
    for it in items:
        assert flags[it["id"]] == py_pass(it, outs[it["id"]])
