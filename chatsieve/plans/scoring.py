"""Registered scoring queries (E1-E11, E20) on ``conversations``.

Evaluation items are the user turns: the scene comes from ``classify`` and the
keyword groups are the question's own words of 7+ letters (each word or its
reversal satisfies its group), so the rule set grows with the data.  The
answer to score is the assistant turn that follows, written in the two-line
answer format with the scene ``classify`` gives the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions.text import literal_array
from chatsieve.operators.dataset import classify
from chatsieve.operators.preference import compose_answer
from chatsieve.operators.rules import (
    behaviour_hit_rates, eval_summary, eval_summary_by, extract_output, rule_pass_rates, score_outputs,
)
from chatsieve.plans.common import (
    SQL_WS, TEST_CATEGORIES, TEST_FORBIDDEN, TEST_KEYWORD_MIN_LEN, TEST_SCENES, flat_groups, r6,
    register, sql_scene_case, table,
)

KEY = ["conv_id", "turn"]


def eval_items(spark, sf) -> DataFrame:
    conv = table(spark, sf, "conversations")
    q = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    words = F.split(F.lower("question"), r"[^\p{L}]+")
    groups = F.transform(F.filter(words, lambda w: F.char_length(w) >= TEST_KEYWORD_MIN_LEN),
                         lambda w: F.array(w, F.reverse(w)))
    return q.select(*KEY, "question",
                    classify("question", TEST_SCENES, "other").alias("category"),
                    groups.alias("must_have_any"),
                    literal_array(TEST_FORBIDDEN).alias("forbidden"))


def eval_outputs(spark, sf, offset: int = 1, run: str | None = None) -> DataFrame:
    """Assistant turn ``offset`` turns after each question, as a composed answer."""
    conv = table(spark, sf, "conversations")
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - offset).alias("turn"), F.col("text"))
    out = a.select(*KEY, compose_answer(classify("text", TEST_SCENES, "other"), F.col("text")).alias("output"))
    return out if run is None else out.withColumn("run", F.lit(run))


# ---------------------------------------------------------------- SQL pieces
def _sql_items() -> str:
    return f"""items AS (
  SELECT conv_id, turn, text AS question, {sql_scene_case('text')} AS category,
         list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'),
                                    lambda w: length(w) >= {TEST_KEYWORD_MIN_LEN}),
                        lambda w: [w, reverse(w)]) AS groups
  FROM conversations WHERE role = 'user')"""


def _sql_outputs(offset: int = 1, run: str | None = None) -> str:
    run_col = f"'{run}' AS run, " if run else ""
    return f"""SELECT {run_col}conv_id, turn - {offset} AS turn,
         '场景分类：' || {sql_scene_case('text')} || chr(10) || '客服回复：' || text AS output
  FROM conversations WHERE role = 'assistant'"""


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


SQL_CATS = _sql_list(TEST_CATEGORIES)
SQL_FORBIDDEN = _sql_list(TEST_FORBIDDEN)


def _sql_scored(outputs_cte: str, key="conv_id, turn") -> str:
    """CTE chain ending in ``scored`` (detail rows)."""
    return f"""WITH {_sql_items()},
outs AS ({outputs_cte}),
j AS (
  SELECT i.*, o.* EXCLUDE (conv_id, turn), regexp_replace(o.output, '{SQL_WS}+', '', 'g') AS norm
  FROM items i JOIN outs o USING (conv_id, turn)),
raw AS (
  SELECT *, regexp_replace(regexp_extract(output, '场景分类[:：]{SQL_WS}*([^\\n\\r]+)', 1),
                           '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS rawcat
  FROM j),
scored AS (
  SELECT *,
    len(list_filter(groups, lambda g: len(list_filter(g, lambda t: t <> '' AND contains(norm, t))) > 0)) AS must_hit_count,
    len(groups) AS must_total,
    list_filter(groups, lambda g: len(list_filter(g, lambda t: t <> '' AND contains(norm, t))) = 0) AS missed,
    list_filter({SQL_FORBIDDEN}, lambda t: t <> '' AND contains(norm, t)) AS fhits,
    coalesce(list_filter({SQL_CATS}, lambda c: contains(rawcat, c))[1], left(rawcat, 20), '') AS pred_category
  FROM raw)"""


def _flat_sql(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda g: array_to_string(g, '|')), ';')"


# ---------------------------------------------------------------- E8
def q_score_outputs(spark, sf):
    scored = score_outputs(eval_items(spark, sf), eval_outputs(spark, sf), use_gold_category=False,
                           key=KEY, categories=TEST_CATEGORIES)
    return scored.select(
        *KEY, "category", "risk_level", "pred_category", "category_correct", "must_hit_count",
        "must_total", r6(F.col("rule_score")).alias("rule_score"),
        flat_groups(F.col("missed_groups")).alias("missed_groups"),
        F.array_join("forbidden_hits", "|").alias("forbidden_hits"), "risky")


SQL_SCORE_OUTPUTS = _sql_scored(_sql_outputs()) + f"""
SELECT conv_id, turn, category, '' AS risk_level, pred_category,
       CAST(pred_category = category AS INTEGER) AS category_correct,
       CAST(must_hit_count AS INTEGER) AS must_hit_count, CAST(must_total AS INTEGER) AS must_total,
       round(must_hit_count / greatest(1, must_total), 6) AS rule_score,
       {_flat_sql('missed')} AS missed_groups,
       array_to_string(fhits, '|') AS forbidden_hits,
       CAST(len(fhits) > 0 AS INTEGER) AS risky
FROM scored"""

register("score_outputs", SQL_SCORE_OUTPUTS)(q_score_outputs)


# ---------------------------------------------------------------- E9
def q_eval_summary(spark, sf):
    scored = score_outputs(eval_items(spark, sf), eval_outputs(spark, sf), use_gold_category=False,
                           key=KEY, categories=TEST_CATEGORIES)
    s = eval_summary(scored, use_gold_category=False)
    return s.select("num_samples", r6(F.col("avg_rule_score")).alias("avg_rule_score"),
                    r6(F.col("risky_response_rate")).alias("risky_response_rate"),
                    "use_gold_category", r6(F.col("category_accuracy")).alias("category_accuracy"))


SQL_EVAL_SUMMARY = _sql_scored(_sql_outputs()) + """
SELECT count(*) AS num_samples,
       round(avg(must_hit_count / greatest(1, must_total)), 6) AS avg_rule_score,
       round(avg(CAST(len(fhits) > 0 AS DOUBLE)), 6) AS risky_response_rate,
       false AS use_gold_category,
       round(sum(CAST(pred_category = category AS INTEGER)) / greatest(1, count(*)), 6) AS category_accuracy
FROM scored"""

register("eval_summary", SQL_EVAL_SUMMARY)(q_eval_summary)


# ---------------------------------------------------------------- E10
def two_run_outputs(spark, sf) -> DataFrame:
    """Run 'next' answers with the following assistant turn, run 'later' with the one after.

    One scan: every assistant turn is emitted under both offsets by an in-row
    explode (not a union of two scans)."""
    conv = table(spark, sf, "conversations")
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", "text",
        F.explode(F.array(
            F.struct(F.lit("next").alias("run"), (F.col("turn") - 1).alias("turn")),
            F.struct(F.lit("later").alias("run"), (F.col("turn") - 3).alias("turn")))).alias("__r"))
    return a.select("conv_id", F.col("__r.turn").alias("turn"),
                    compose_answer(classify("text", TEST_SCENES, "other"), F.col("text")).alias("output"),
                    F.col("__r.run").alias("run"))


def q_eval_summary_by_scene(spark, sf):
    scored = score_outputs(eval_items(spark, sf), two_run_outputs(spark, sf), use_gold_category=False,
                           key=KEY, categories=TEST_CATEGORIES)
    s = eval_summary_by(scored, by=["run", "category"], sets=[["run"], ["run", "category"]],
                        use_gold_category=False)
    return s.select("run", "category", "grouping_id", "num_samples",
                    r6(F.col("avg_rule_score")).alias("avg_rule_score"),
                    r6(F.col("risky_response_rate")).alias("risky_response_rate"),
                    r6(F.col("category_accuracy")).alias("category_accuracy"))


SQL_EVAL_SUMMARY_BY_SCENE = _sql_scored(
    _sql_outputs(1, "next") + " UNION ALL " + _sql_outputs(3, "later")) + """
SELECT run, category, CAST(grouping(run, category) AS BIGINT) AS grouping_id, count(*) AS num_samples,
       round(avg(must_hit_count / greatest(1, must_total)), 6) AS avg_rule_score,
       round(avg(CAST(len(fhits) > 0 AS DOUBLE)), 6) AS risky_response_rate,
       round(sum(CAST(pred_category = category AS INTEGER)) / greatest(1, count(*)), 6) AS category_accuracy
FROM scored GROUP BY GROUPING SETS ((run), (run, category))"""

register("eval_summary_by_scene", SQL_EVAL_SUMMARY_BY_SCENE)(q_eval_summary_by_scene)


# ---------------------------------------------------------------- E11
PASS_FORBIDDEN = [t for t in TEST_FORBIDDEN if t]


def q_rule_pass_rates(spark, sf):
    items = eval_items(spark, sf).withColumn("forbidden", literal_array(PASS_FORBIDDEN))
    j = items.join(two_run_outputs(spark, sf), on=KEY, how="inner")
    r = rule_pass_rates(j, by=["run"])
    return r.select("run", "num_samples", r6(F.col("must_have_pass_rate")).alias("must_have_pass_rate"),
                    r6(F.col("forbidden_hit_rate")).alias("forbidden_hit_rate"))


SQL_RULE_PASS_RATES = f"""WITH {_sql_items()},
outs AS ({_sql_outputs(1, "next")} UNION ALL {_sql_outputs(3, "later")}),
j AS (SELECT i.*, o.run, o.output FROM items i JOIN outs o USING (conv_id, turn))
SELECT run, count(*) AS num_samples,
  round(avg(CAST(len(groups) = 0 OR len(list_filter(groups, lambda g: len(list_filter(g, lambda k: contains(output, k))) = 0)) = 0 AS DOUBLE)), 6) AS must_have_pass_rate,
  round(avg(CAST(len(list_filter({_sql_list(PASS_FORBIDDEN)}, lambda k: contains(output, k))) > 0 AS DOUBLE)), 6) AS forbidden_hit_rate
FROM j GROUP BY run"""

register("rule_pass_rates", SQL_RULE_PASS_RATES)(q_rule_pass_rates)


# ---------------------------------------------------------------- E1
def q_extract_output(spark, sf):
    conv = table(spark, sf, "conversations")
    recs = conv.select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", F.col("text")).alias("output"),
        F.when(F.col("role") == "user", F.concat(F.lit(" 　"), F.col("text"), F.lit("\n"))).alias("response"),
        F.col("turn").alias("answer"))  # not a string column: skipped
    out = extract_output(recs)
    return out.select("conv_id", "turn", F.col("output").alias("extracted"))


SQL_EXTRACT_OUTPUT = f"""SELECT conv_id, turn,
  regexp_replace(coalesce(CASE WHEN role = 'assistant' THEN text END,
                          CASE WHEN role = 'user' THEN ' ' || chr(12288) || text || chr(10) END),
                 '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS extracted
FROM conversations"""

register("extract_output", SQL_EXTRACT_OUTPUT)(q_extract_output)


# ---------------------------------------------------------------- E20
BEHAVIOURS = {"soothing": ["erth", "heit"], "advice": ["le", "que"], "action": ["tion", "ung"]}
BANNED = ["einach", "ouai"]


def q_behaviour_hit_rates(spark, sf):
    # Answers to a question only: what follows it by one and by three turns.
    asked = table(spark, sf, "conversations").where(F.col("role") == "user").select(*KEY)
    outs = two_run_outputs(spark, sf).join(asked, KEY)
    r = behaviour_hit_rates(outs, "output", BEHAVIOURS, BANNED, by=["run"])
    return r.select("run", "num_samples", *[r6(F.col(c)).alias(c) for c in r.columns
                                            if c.endswith("_rate")])


def _sql_behaviour() -> str:
    rates = []
    all_terms = []
    for name, terms in BEHAVIOURS.items():
        cond = f"len(list_filter({_sql_list(terms)}, lambda t: contains(output, t))) > 0"
        all_terms.append(cond)
        rates.append(f"round(avg(CAST({cond} AS DOUBLE)), 6) AS {name}_rate")
    clean = f"len(list_filter({_sql_list(BANNED)}, lambda t: contains(output, t))) = 0"
    rates.append(f"round(avg(CAST({clean} AS DOUBLE)), 6) AS no_banned_rate")
    rates.append(f"round(avg(CAST({clean} AND {' AND '.join(all_terms)} AS DOUBLE)), 6) AS all_behaviours_rate")
    return f"""WITH pairs AS ({_sql_outputs(1, "next")} UNION ALL {_sql_outputs(3, "later")}),
outs AS (SELECT * FROM pairs WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'user'))
SELECT run, count(*) AS num_samples, {', '.join(rates)} FROM outs GROUP BY run"""


register("behaviour_hit_rates", _sql_behaviour())(q_behaviour_hit_rates)
