"""Registered dataset-building queries (C16-C24, P6) on ``documents``,
``labels`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.text import effective_chars
from chatsieve.operators import clean as C
from chatsieve.operators import dataset as DS
from chatsieve.plans.common import TEST_SCENES, r6, register, sql_scene_case, table

SEED = 42
TOP_K = 100
QUOTA_N = 300
QUOTA_FLOORS = {"es": 60}
SAMPLE_N = 50
EVAL_FRACTION = 0.1

SQL_EFF = "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))"


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_hash(col: str) -> str:
    return f"md5('{SEED}|' || CAST({col} AS VARCHAR))"


# ---------------------------------------------------------------- C16
def q_classify(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", DS.classify("text", TEST_SCENES, "other").alias("category"))


register("classify", f"""
SELECT doc_id, lang, {sql_scene_case('text')} AS category FROM documents""")(q_classify)


# ---------------------------------------------------------------- C17
def scored_docs(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    score = F.coalesce(F.col("quality"), F.lit(0)) + effective_chars("text") / 5000.0
    return docs.join(labels, "doc_id", "left").withColumn("score", score)


def q_quality_top_k(spark, sf):
    top = DS.quality_top_k(scored_docs(spark, sf), "score", TOP_K, "doc_id")
    return top.select("doc_id", r6(F.col("score")).alias("score"))


SQL_SCORED = f"""scored AS (
  SELECT d.doc_id, d.text, coalesce(l.quality, 0) + {SQL_EFF} / 5000.0 AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

register("quality_top_k", f"""WITH {SQL_SCORED}
SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT {TOP_K}
""")(q_quality_top_k)


def q_longest_half(spark, sf):
    """Half of the table: far more rows than a task should hold, with many ties in the key."""
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("long").alias("size_class"))
    return DS.quality_top_k(docs, "size_class", docs.count() // 2, "doc_id")


register("longest_half", """
WITH r AS (SELECT doc_id, n_chars // 100 AS size_class,
                  row_number() OVER (ORDER BY n_chars // 100 DESC NULLS LAST, doc_id) AS rn FROM documents)
SELECT doc_id, CAST(size_class AS BIGINT) AS size_class FROM r WHERE rn <= (SELECT count(*) // 2 FROM documents)
""")(q_longest_half)


# ---------------------------------------------------------------- C18
VARIANTS = [
    {"name": "strict20_all", "min_chars": D.STRICT_MIN_CHARS},
    {"name": "strict20_top", "min_chars": D.STRICT_MIN_CHARS, "top_k": 300},
    {"name": "relaxed12_top", "min_chars": D.RELAXED_MIN_CHARS, "top_k": 500},
]


def q_variants(spark, sf):
    s = scored_docs(spark, sf)
    v = DS.variants(s, effective_chars("text"), F.col("score"), "doc_id", VARIANTS)
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum("doc_id").cast("long").alias("sum_doc_id"))


def _sql_variants() -> str:
    parts = []
    for v in VARIANTS:
        sel = f"SELECT '{v['name']}' AS variant, doc_id FROM scored WHERE {SQL_EFF} >= {v['min_chars']}"
        if v.get("top_k"):
            sel = f"SELECT * FROM ({sel} ORDER BY score DESC, doc_id LIMIT {v['top_k']})"
        parts.append(sel)
    return f"""WITH {SQL_SCORED}, u AS ({' UNION ALL '.join(parts)})
SELECT variant, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS sum_doc_id FROM u GROUP BY variant"""


register("variants", _sql_variants())(q_variants)


# ---------------------------------------------------------------- C19
def q_split_train_eval(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return DS.split_train_eval(docs, "doc_id", EVAL_FRACTION, SEED)


register("split_train_eval", f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr({sql_hash('doc_id')}, 1, 13) AS BIGINT) / 4503599627370496.0 < {EVAL_FRACTION}
                    THEN 'eval' ELSE 'train' END AS split
FROM documents""")(q_split_train_eval)


def q_split_exact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return DS.split_train_eval_exact(docs, "doc_id", EVAL_FRACTION, SEED, stratum="lang")


register("split_exact", f"""
SELECT doc_id, lang,
  CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id')}, doc_id)
            <= CAST(round(count(*) OVER (PARTITION BY lang) * {EVAL_FRACTION}) AS BIGINT)
       THEN 'eval' ELSE 'train' END AS split
FROM documents""")(q_split_exact)


# ---------------------------------------------------------------- C20
def q_category_distribution(spark, sf):
    docs = table(spark, sf, "documents").select(DS.classify("text", TEST_SCENES, "other").alias("category"))
    d = DS.category_distribution(docs, "category")
    return d.select("category", "n", r6(F.col("share")).alias("share"))


register("category_distribution", f"""
SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT {sql_scene_case('text')} AS category FROM documents) GROUP BY category
""")(q_category_distribution)


# ---------------------------------------------------------------- C21
def q_quota_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return DS.quota_sample(docs, "lang", "doc_id", QUOTA_N, SEED, QUOTA_FLOORS)


def _sql_floor(col: str) -> str:
    cases = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in QUOTA_FLOORS.items())
    return f"CASE {cases} ELSE 0 END"


SQL_QUOTAS = f"""c AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang),
r AS (SELECT lang, c, least(c, {_sql_floor('lang')}) AS reserved FROM c),
t AS (SELECT *, c - reserved AS cap,
             greatest(least({QUOTA_N}, sum(c) OVER ()) - sum(reserved) OVER (), 0) AS rest FROM r),
u AS (SELECT *, CASE WHEN sum(cap) OVER () > 0 THEN rest * cap / sum(cap) OVER () ELSE 0.0 END AS ideal FROM t),
v AS (SELECT *, CAST(floor(ideal) AS BIGINT) AS base FROM u),
w AS (SELECT *, rest - sum(base) OVER () AS lft,
             row_number() OVER (ORDER BY ideal - base DESC, lang) AS rk FROM v),
q AS (SELECT lang, reserved + base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM w)"""

register("quota_sample", f"""WITH {SQL_QUOTAS},
ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id')}, doc_id) AS rn
           FROM documents)
SELECT doc_id, lang FROM ranked JOIN q USING (lang) WHERE rn <= quota""")(q_quota_sample)


# ---------------------------------------------------------------- C22
def qa_with_category(spark, sf):
    pairs = C.extract_qa_pairs(table(spark, sf, "conversations"))
    return pairs.withColumn("category", DS.classify("question", TEST_SCENES, "other"))


def q_build_messages(spark, sf):
    rows = DS.build_messages(qa_with_category(spark, sf))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\t"), m["content"])), "\n")
    return rows.select("conv_id", "turn", "category", "source", F.size("messages").alias("n_messages"),
                       F.md5(flat).alias("messages_md5"))


SQL_QA_CAT = f"""qa AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, {sql_scene_case('q.text')} AS category
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

register("build_messages", f"""WITH {SQL_QA_CAT}
SELECT conv_id, turn, category, 'raw_cleaned' AS source, 3 AS n_messages,
  md5('system' || chr(9) || {sql_lit(D.SYSTEM_PROMPT)} || chr(10) ||
      'user' || chr(9) || '{D.CATEGORY_LABEL}' || category || chr(10) || '{D.USER_QUESTION_LABEL}' || question
      || chr(10) || 'assistant' || chr(9) || answer) AS messages_md5
FROM qa""")(q_build_messages)


def q_build_context_messages(spark, sf):
    """Every assistant turn after the first turn: scene of the last user line, dialogue so far, reply."""
    turns = table(spark, sf, "conversations")
    named = turns.withColumn("line", DS.speaker_line("role", "text"))
    context = C.context_text(named.select("conv_id", "turn", "role", F.col("line").alias("text")), prefix_role=False)
    rows = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    rows = rows.join(context, ["conv_id", "turn"]).withColumn("category", DS.classify("context", TEST_SCENES, "other"))
    m = DS.build_context_messages(rows)
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\t"), x["content"])), "\n")
    return m.select("conv_id", "turn", "category", F.md5(flat).alias("messages_md5"))


register("build_context_messages", f"""
WITH t AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
ctx AS (
  SELECT t.conv_id, t.turn, t.answer,
         string_agg(CASE c.role WHEN 'user' THEN '{D.SPEAKER_NAMES['user']}' WHEN 'assistant'
                    THEN '{D.SPEAKER_NAMES['assistant']}' ELSE c.role END || '：' || c.text, chr(10) ORDER BY c.turn) AS context
  FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn < t.turn GROUP BY ALL),
k AS (SELECT *, {sql_scene_case('context')} AS category FROM ctx)
SELECT conv_id, turn, category, md5('system' || chr(9) || {sql_lit(D.SERVICE_SYSTEM_PROMPT)} || chr(10) || 'user' || chr(9) ||
  '{D.CONTEXT_TASK}' || chr(10) || chr(10) || '{D.CONTEXT_SCENE_LABEL}' || category || chr(10) || '{D.CONTEXT_LABEL}' || chr(10) ||
  context || chr(10) || 'assistant' || chr(9) || answer) AS messages_md5
FROM k""")(q_build_context_messages)


# ---------------------------------------------------------------- C23
def q_instruction_rows(spark, sf):
    pairs = C.extract_qa_pairs(table(spark, sf, "conversations"))
    rows = DS.build_instruction_rows(pairs)
    return rows.select(F.md5("instruction").alias("instruction_md5"), "input",
                       F.md5("output").alias("output_md5"))


register("instruction_rows", """
SELECT md5(q.text) AS instruction_md5, '' AS input, md5(a.text) AS output_md5
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")(q_instruction_rows)


# ---------------------------------------------------------------- C24
def q_profile(spark, sf):
    return DS.profile(table(spark, sf, "documents"), "doc_id")


def _sql_profile(column: str, kind: str, position: int) -> str:
    return f"""SELECT '{column}' AS "column", '{kind}' AS data_type, count({column}) AS non_null, count(*) AS n_rows,
  {position} AS position, CAST(arg_min({column}, doc_id) AS VARCHAR) AS first_value FROM documents"""


register("profile", " UNION ALL ".join(_sql_profile(c, k, i) for i, (c, k) in enumerate(
    [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")])))(q_profile)


# ---------------------------------------------------------------- P6
def q_sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return DS.sample_rows(docs, SAMPLE_N, "doc_id", SEED)


register("sample_rows", f"""
SELECT doc_id, lang FROM documents ORDER BY {sql_hash('doc_id')}, doc_id LIMIT {SAMPLE_N}""")(q_sample_rows)
