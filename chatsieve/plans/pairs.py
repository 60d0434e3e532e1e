"""Registered preference-pair queries (D1-D12) on ``conversations``.

Source rows are question/answer pairs.  The chosen answer is the reply in
the two-line answer format; the rejected answer is the assistant reply two
turns later (absent for the last pair, which makes an invalid pair).  The
prompt columns vary with the question's position so that every branch of
prompt resolution is exercised: no prompt (turn 0), an empty prompt that
falls through to ``user_prompt`` (turn 2), an already rendered prompt
(turn 4), a prompt already holding the question label (turn 6), and a plain
prompt otherwise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.chat import render_prompt
from chatsieve.functions.text import literal_array
from chatsieve.operators import preference as P
from chatsieve.operators.clean import extract_qa_pairs
from chatsieve.operators.dataset import classify
from chatsieve.plans.common import SQL_WS, TEST_CATEGORIES, TEST_SCENES, register, sql_scene_case, table

ACTION_TERMS = ["tion", "ung", "que"]
CLAIMS = {"english": ["the and", "ing the"], "german": ["und die", "ein"],
          "french": ["le la", "des"], "spanish": ["que el", "los"]}
MUST_INCLUDE = [["场景分类"], ["客服回复"], ["the", "die", "la", "el"]]
HIGH_CATEGORIES = ["german"]
MEDIUM_TERMS = ["the", "die", "la"]
SHORT_REPLY = "好的"


def pref_source(spark, sf):
    conv = table(spark, sf, "conversations")
    pairs = extract_qa_pairs(conv)
    later = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("later"))
    src = pairs.join(later, ["conv_id", "turn"], "left") \
        .withColumn("category", classify("question", TEST_SCENES, "other"))
    t = F.col("turn")
    prompt = (F.when(t == 0, F.lit(None).cast("string"))
              .when(t == 2, F.lit(""))
              .when(t == 4, render_prompt(F.col("question")))
              .when(t == 6, F.concat(F.lit(D.USER_QUESTION_LABEL), F.col("question")))
              .otherwise(F.col("question")))
    return src.select(
        "conv_id", "turn", "question", "category", "answer", "later",
        prompt.alias("prompt"),
        F.when(t == 2, F.col("question")).alias("user_prompt"),
        P.compose_answer(F.col("category"), F.col("answer")).alias("chosen"),
        F.when(F.col("later").isNotNull(), P.compose_answer(F.col("category"), F.col("later"))).alias("rejected"))


# ---------------------------------------------------------------- SQL helpers
def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_render(user: str) -> str:
    head = D.IM_START + "system\n" + D.SYSTEM_PROMPT + D.IM_END + "\n" + D.IM_START + "user\n"
    tail = D.IM_END + "\n" + D.IM_START + "assistant\n" + D.EMPTY_THINK_BLOCK
    return f"({sql_lit(head)} || {user} || {sql_lit(tail)})"


def sql_normalize(x: str) -> str:
    pre = D.CHOOSE_CATEGORY_PREAMBLE + D.CATEGORY_JOINER.join(TEST_CATEGORIES) + "\n" + D.USER_QUESTION_LABEL
    return (f"CASE WHEN contains({sql_trim(x)}, '{D.USER_QUESTION_LABEL}') THEN {sql_trim(x)} "
            f"ELSE {sql_lit(pre)} || {sql_trim(x)} END")


def sql_compose(cat: str, reply: str) -> str:
    return f"('{D.CATEGORY_LABEL}' || {cat} || chr(10) || '{D.REPLY_LABEL}' || {reply})"


SQL_SOURCE = f"""src AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, l.text AS later,
         {sql_scene_case('q.text')} AS category
  FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations l ON l.conv_id = q.conv_id AND l.turn = q.turn + 3 AND l.role = 'assistant'
  WHERE q.role = 'user'),
pairs AS (
  SELECT *,
    CASE turn WHEN 0 THEN NULL WHEN 2 THEN '' WHEN 4 THEN {sql_render('question')}
              WHEN 6 THEN '{D.USER_QUESTION_LABEL}' || question ELSE question END AS prompt,
    CASE WHEN turn = 2 THEN question END AS user_prompt,
    {sql_compose('category', 'answer')} AS chosen,
    CASE WHEN later IS NOT NULL THEN {sql_compose('category', 'later')} END AS rejected
  FROM src)"""

SQL_RESOLVED = f"""resolved AS (
  SELECT *,
    CASE WHEN prompt IS NOT NULL AND prompt <> '' THEN
           CASE WHEN contains({sql_trim('prompt')}, '{D.IM_START}') OR contains({sql_trim('prompt')}, '{D.ALT_HEADER_MARKER}')
                THEN {sql_trim('prompt')} ELSE {sql_render(sql_normalize('prompt'))} END
         WHEN user_prompt IS NOT NULL AND user_prompt <> '' THEN {sql_render(sql_normalize('user_prompt'))}
         WHEN question IS NOT NULL AND question <> '' THEN {sql_render(sql_normalize('question'))} END AS fprompt,
    CASE WHEN coalesce({sql_trim('chosen')}, '') = '' THEN 'empty_chosen'
         WHEN coalesce({sql_trim('rejected')}, '') = '' THEN 'empty_rejected'
         WHEN coalesce(nullif(prompt, ''), nullif(user_prompt, ''), nullif(question, '')) IS NULL THEN 'no_prompt'
         WHEN {sql_trim("coalesce(nullif(prompt, ''), nullif(user_prompt, ''), nullif(question, ''))")} = ''
              THEN 'blank_prompt' END AS problem
  FROM pairs)"""


# ---------------------------------------------------------------- D1-D5
def q_format_pairs(spark, sf):
    valid, _q = P.format_pairs(pref_source(spark, sf), categories=TEST_CATEGORIES, keep=["conv_id", "turn"])
    return valid.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"),
                        F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


register("format_pairs", f"""WITH {SQL_SOURCE}, {SQL_RESOLVED}
SELECT conv_id, turn, md5(fprompt) AS prompt_md5, md5({sql_trim('chosen')}) AS chosen_md5,
       md5({sql_trim('rejected')}) AS rejected_md5
FROM resolved WHERE problem IS NULL OR problem = 'blank_prompt'""")(q_format_pairs)


def q_pair_quarantine(spark, sf):
    _v, quarantine = P.format_pairs(pref_source(spark, sf), categories=TEST_CATEGORIES)
    return quarantine.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


register("pair_quarantine", f"""WITH {SQL_SOURCE}, {SQL_RESOLVED}
SELECT problem, count(*) AS n FROM resolved WHERE problem IS NOT NULL GROUP BY problem""")(q_pair_quarantine)


# ---------------------------------------------------------------- D7
def variants_spec():
    q, cat, ans = F.col("question"), F.col("category"), F.col("answer")
    wrong = F.when(cat == "other", F.lit("english")).otherwise(F.lit("other"))
    infer = P.normalize_user_prompt(q, TEST_CATEGORIES)
    return [
        {"prompt_type": "infer_category", "user_prompt": infer, "rejected": P.compose_answer(wrong, ans),
         "rejected_source": "misclassified"},
        {"prompt_type": "infer_category", "user_prompt": infer, "rejected": P.compose_answer(cat, q),
         "rejected_source": "no_action"},
        {"prompt_type": "infer_category", "user_prompt": infer,
         "rejected": P.compose_answer(cat, F.concat(ans, F.lit(D.RISKY_REPLY_PHRASES[3]))),
         "rejected_source": "banned_promise"},
        {"prompt_type": "infer_category", "user_prompt": infer,
         "rejected": F.when(F.col("later").isNotNull(), P.compose_answer(cat, F.col("later"))),
         "rejected_source": "model_output"},
        {"prompt_type": "given_category", "user_prompt": P.given_category_prompt(cat, q),
         "rejected": P.compose_answer(cat, F.lit(SHORT_REPLY)), "rejected_source": "too_short"},
    ]


def expanded(spark, sf):
    src = pref_source(spark, sf)
    return P.expand_pairs(src, variants_spec(), keep=["conv_id", "turn", "question", "category"])


def q_expand_pairs(spark, sf):
    e = expanded(spark, sf)
    return e.select("conv_id", "turn", "prompt_type", "variant_no", "rejected_source",
                    F.md5("user_prompt").alias("user_prompt_md5"), F.md5("rejected").alias("rejected_md5"))


SQL_EXPANDED = f"""exp AS (
  SELECT conv_id, turn, question, category, chosen, 'infer_category' AS prompt_type, 0 AS variant_no,
         {sql_normalize('question')} AS user_prompt,
         {sql_compose("CASE WHEN category = 'other' THEN 'english' ELSE 'other' END", 'answer')} AS rejected,
         'misclassified' AS rejected_source FROM pairs
  UNION ALL
  SELECT conv_id, turn, question, category, chosen, 'infer_category', 1, {sql_normalize('question')},
         {sql_compose('category', 'question')}, 'no_action' FROM pairs
  UNION ALL
  SELECT conv_id, turn, question, category, chosen, 'infer_category', 2, {sql_normalize('question')},
         {sql_compose('category', "answer || " + sql_lit(D.RISKY_REPLY_PHRASES[3]))}, 'banned_promise' FROM pairs
  UNION ALL
  SELECT conv_id, turn, question, category, chosen, 'infer_category', 3, {sql_normalize('question')},
         {sql_compose('category', 'later')}, 'model_output' FROM pairs WHERE later IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, question, category, chosen, 'given_category', 4,
         '{D.CATEGORY_LABEL}' || category || chr(10) || '{D.USER_QUESTION_LABEL}' || question,
         {sql_compose('category', sql_lit(SHORT_REPLY))}, 'too_short' FROM pairs)"""

register("expand_pairs", f"""WITH {SQL_SOURCE}, {SQL_EXPANDED}
SELECT conv_id, turn, prompt_type, variant_no, rejected_source, md5(user_prompt) AS user_prompt_md5,
       md5(rejected) AS rejected_md5 FROM exp""")(q_expand_pairs)


# ---------------------------------------------------------------- D8
def q_rejected_defects(spark, sf):
    e = expanded(spark, sf)
    tags = P.rejected_defects("rejected", "category", min_chars=D.STRICT_MIN_CHARS, action_terms=ACTION_TERMS,
                              banned_terms=D.RISKY_REPLY_PHRASES, question="question",
                              categories=TEST_CATEGORIES)
    return e.select("conv_id", "turn", "variant_no", F.array_join(tags, ",").alias("defects"))


def _sql_list(values) -> str:
    return "[" + ", ".join(sql_lit(v) for v in values) + "]::VARCHAR[]"


SQL_PRED_CAT = (f"coalesce(list_filter({_sql_list(TEST_CATEGORIES)}, lambda c: contains(rawcat, c))[1], "
                f"left(rawcat, 20), '')")
SQL_RAWCAT = (f"regexp_replace(regexp_extract(rejected, '场景分类[:：]{SQL_WS}*([^\\n\\r]+)', 1), "
              f"'^{SQL_WS}+|{SQL_WS}+$', '', 'g')")

register("rejected_defects", f"""WITH {SQL_SOURCE}, {SQL_EXPANDED},
d AS (SELECT *, {SQL_RAWCAT} AS rawcat,
        list_filter(regexp_split_to_array(lower(question), '[^\\p{{L}}]+'), lambda w: length(w) >= 4) AS words
      FROM exp)
SELECT conv_id, turn, variant_no, concat_ws(',',
  CASE WHEN length(regexp_replace(rejected, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < {D.STRICT_MIN_CHARS} THEN 'too_short' END,
  CASE WHEN len(list_filter({_sql_list(ACTION_TERMS)}, lambda t: contains(rejected, t))) = 0 THEN 'no_action' END,
  CASE WHEN len(list_filter({_sql_list(D.RISKY_REPLY_PHRASES)}, lambda t: contains(rejected, t))) > 0 THEN 'banned_promise' END,
  CASE WHEN {SQL_PRED_CAT} <> category THEN 'misclassified' END,
  CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: contains(lower(rejected), w))) = 0 THEN 'off_topic' END
) AS defects FROM d""")(q_rejected_defects)


# ---------------------------------------------------------------- D9
def q_check_pairs(spark, sf):
    e = expanded(spark, sf)
    return P.check_pairs(e, MUST_INCLUDE, triplet=("user_prompt", "chosen", "rejected"))


def _sql_violation() -> str:
    conds = [f"len(list_filter({_sql_list(g)}, lambda t: contains(chosen, t))) = 0" for g in MUST_INCLUDE]
    return " OR ".join(conds)


register("check_pairs", f"""WITH {SQL_SOURCE}, {SQL_EXPANDED},
g AS (SELECT user_prompt, chosen, rejected, count(*) AS n,
             sum(CASE WHEN {_sql_violation()} THEN 1 ELSE 0 END) AS v
      FROM exp GROUP BY user_prompt, chosen, rejected)
SELECT CAST(sum(n) AS BIGINT) AS num_pairs, CAST(sum(v) AS BIGINT) AS violations,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_triplets FROM g""")(q_check_pairs)


# ---------------------------------------------------------------- D9b
def q_targeted_claims(spark, sf):
    e = expanded(spark, sf)
    hits = P.targeted_claims("rejected", "category", CLAIMS)
    return e.select("conv_id", "turn", "variant_no", F.array_join(hits, "|").alias("claims"))


def _sql_claims() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in CLAIMS.items())
    return f"CASE category {cases} ELSE []::VARCHAR[] END"


register("targeted_claims", f"""WITH {SQL_SOURCE}, {SQL_EXPANDED}
SELECT conv_id, turn, variant_no,
       array_to_string(list_filter({_sql_claims()}, lambda t: t <> '' AND contains(rejected, t)), '|') AS claims
FROM exp""")(q_targeted_claims)


# ---------------------------------------------------------------- D10 / D12
def risk_level():
    return P.assign_risk_level("category", "rejected", high_categories=HIGH_CATEGORIES,
                               high_terms=D.RISKY_REPLY_PHRASES, medium_terms=MEDIUM_TERMS)


def q_pair_stats(spark, sf):
    e = expanded(spark, sf).withColumn("risk_level", risk_level())
    return P.pair_stats(e)


register("pair_stats", f"""WITH {SQL_SOURCE}, {SQL_EXPANDED},
r AS (SELECT *, CASE WHEN category IN ('german') THEN 'high'
                     WHEN len(list_filter({_sql_list(D.RISKY_REPLY_PHRASES)}, lambda t: contains(rejected, t))) > 0 THEN 'high'
                     WHEN len(list_filter({_sql_list(MEDIUM_TERMS)}, lambda t: contains(rejected, t))) > 0 THEN 'medium'
                     ELSE 'low' END AS risk_level FROM exp)
SELECT 'category' AS dimension, category AS value, count(*) AS n FROM r GROUP BY category
UNION ALL SELECT 'prompt_type', prompt_type, count(*) FROM r GROUP BY prompt_type
UNION ALL SELECT 'risk_level', risk_level, count(*) FROM r GROUP BY risk_level
UNION ALL SELECT 'num_pairs', NULL, count(*) FROM r""")(q_pair_stats)


# ---------------------------------------------------------------- D11
def q_compose_answer(spark, sf):
    src = pref_source(spark, sf)
    return src.select("conv_id", "turn", "category", F.md5("chosen").alias("chosen_md5"),
                      literal_array(TEST_CATEGORIES).getItem(0).alias("first_category"))


register("compose_answer", f"""WITH {SQL_SOURCE}
SELECT conv_id, turn, category, md5(chosen) AS chosen_md5, 'english' AS first_category FROM pairs
""")(q_compose_answer)
