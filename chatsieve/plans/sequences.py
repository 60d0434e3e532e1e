"""Registered prompt / chat / token-sequence queries (P1-P8, D6) on
``conversations``, ``documents`` and ``embeddings``.

Chat rows are built per user turn: system + the question, then the answer
(when the next turn is an assistant turn) and the next question (when there
is one).  That yields rows with no assistant turn, with the assistant last,
and with an assistant followed by a user, which are the cases the chat
layout and the answer masking treat differently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.chat import render_chat
from chatsieve.functions.text import split_list
from chatsieve.operators import tokens as TK
from chatsieve.operators.dataset import classify
from chatsieve.plans.common import SQL_WS, TEST_CATEGORIES, TEST_SCENES, register, sql_scene_case, table
from chatsieve.plans.pairs import sql_lit, sql_render

MAX_LENGTH = 512
BATCH = 8

EMPTY_MSGS = "array<struct<role:string,content:string>>"


def chat_rows(spark, sf):
    conv = table(spark, sf, "conversations")
    q = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                        F.col("text").alias("answer"))
    nq = conv.where(F.col("role") == "user").select("conv_id", (F.col("turn") - 2).alias("turn"),
                                                    F.col("text").alias("next_q"))
    rows = q.join(a, ["conv_id", "turn"], "left").join(nq, ["conv_id", "turn"], "left")
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    empty = F.array().cast(EMPTY_MSGS)
    messages = F.concat(
        F.array(msg("system", F.lit(D.SYSTEM_PROMPT)), msg("user", F.col("question"))),
        F.when(F.col("answer").isNotNull(), F.array(msg("assistant", F.col("answer")))).otherwise(empty),
        F.when(F.col("next_q").isNotNull(), F.array(msg("user", F.col("next_q")))).otherwise(empty))
    return rows.select("conv_id", "turn", "question", "answer", "next_q",
                       classify("question", TEST_SCENES, "other").alias("category"),
                       F.lit("raw_cleaned").alias("source"), messages.alias("messages"))


SQL_ROWS = """rows AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, n.text AS next_q
  FROM conversations q
  LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations n ON n.conv_id = q.conv_id AND n.turn = q.turn + 2 AND n.role = 'user'
  WHERE q.role = 'user')"""


def _frag(role: str, content: str) -> str:
    return f"'{D.IM_START}{role}' || chr(10) || {content} || '{D.IM_END}' || chr(10)"


# Layout of a chat row (texts here hold no think tags): the assistant turn
# gets the empty think block only when it is last (no next question).
SQL_RENDER_GEN = f"""(
  {_frag('system', sql_lit(D.SYSTEM_PROMPT))} || {_frag('user', 'question')} ||
  CASE WHEN answer IS NULL THEN ''
       WHEN next_q IS NULL THEN '{D.IM_START}assistant' || chr(10) || '<think>' || chr(10) || chr(10) ||
            '</think>' || chr(10) || chr(10) || regexp_replace(answer, '^\\n+', '') || '{D.IM_END}' || chr(10)
       ELSE '{D.IM_START}assistant' || chr(10) || answer || '{D.IM_END}' || chr(10) END ||
  CASE WHEN next_q IS NULL THEN '' ELSE {_frag('user', 'next_q')} END ||
  '{D.IM_START}assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10))"""


# ---------------------------------------------------------------- D6 (arrays)
def q_render_chat(spark, sf):
    rows = chat_rows(spark, sf)
    return rows.select("conv_id", "turn", F.size("messages").alias("n_messages"),
                       F.md5(render_chat(F.col("messages"), True, False)).alias("text_md5"))


register("render_chat", f"""WITH {SQL_ROWS}
SELECT conv_id, turn, 2 + CAST(answer IS NOT NULL AS INTEGER) + CAST(next_q IS NOT NULL AS INTEGER) AS n_messages,
       md5({SQL_RENDER_GEN}) AS text_md5 FROM rows""")(q_render_chat)


# ---------------------------------------------------------------- D6 (turn rows)
def q_chat_fragments(spark, sf):
    f = TK.chat_fragments(table(spark, sf, "conversations"), with_tools=True)
    return f.select("conv_id", "turn", "role", F.md5("fragment").alias("fragment_md5"))


register("chat_fragments", f"""WITH s AS (
  SELECT conv_id, max(turn) + 1 AS n,
         max(CASE WHEN role = 'user' AND NOT (starts_with(text, '<tool_response>') AND ends_with(text, '</tool_response>'))
                  THEN turn END) AS lq
  FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, md5(CASE
  WHEN c.role IN ('user', 'system') THEN '{D.IM_START}' || c.role || chr(10) || c.text || '{D.IM_END}' || chr(10)
  WHEN c.role = 'assistant' AND c.turn > coalesce(s.lq, s.n - 1) AND c.turn = s.n - 1 THEN
       '{D.IM_START}assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ||
       regexp_replace(c.text, '^\\n+', '') || '{D.IM_END}' || chr(10)
  WHEN c.role = 'assistant' THEN '{D.IM_START}assistant' || chr(10) || c.text || '{D.IM_END}' || chr(10)
  ELSE '' END) AS fragment_md5
FROM conversations c JOIN s USING (conv_id)""")(q_chat_fragments)


# ---------------------------------------------------------------- P1
def q_eval_prompts(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    cat = classify("text", TEST_SCENES, "other")
    return conv.select("conv_id", "turn",
                       F.md5(TK.build_eval_prompt(F.col("text"), cat, True, TEST_CATEGORIES)).alias("gold_md5"),
                       F.md5(TK.build_eval_prompt(F.col("text"), cat, False, TEST_CATEGORIES)).alias("infer_md5"))


_PRE = D.CHOOSE_CATEGORY_PREAMBLE + D.CATEGORY_JOINER.join(TEST_CATEGORIES) + "\n" + D.USER_QUESTION_LABEL
register("eval_prompts", f"""
SELECT conv_id, turn,
  md5({sql_render(f"'{D.CATEGORY_LABEL}' || {sql_scene_case('text')} || chr(10) || '{D.USER_QUESTION_LABEL}' || text")}) AS gold_md5,
  md5({sql_render(f"{sql_lit(_PRE)} || text")}) AS infer_md5
FROM conversations WHERE role = 'user'""")(q_eval_prompts)


# ---------------------------------------------------------------- P2 / P3
def q_last_assistant(spark, sf):
    rows = chat_rows(spark, sf)
    prompt_msgs, answer = TK.prompt_and_answer(F.col("messages"))
    return rows.select("conv_id", "turn", TK.last_assistant_index("messages").alias("assistant_index"),
                       F.md5(render_chat(prompt_msgs, True, False)).alias("prompt_md5"),
                       F.md5(answer).alias("answer_md5"))


register("last_assistant", f"""WITH {SQL_ROWS}
SELECT conv_id, turn, CASE WHEN answer IS NOT NULL THEN 2 END AS assistant_index,
  CASE WHEN answer IS NOT NULL THEN md5({sql_render('question')}) END AS prompt_md5,
  CASE WHEN answer IS NOT NULL THEN md5(answer || '{D.IM_END}') END AS answer_md5
FROM rows""")(q_last_assistant)


# ---------------------------------------------------------------- P4
def masked(spark, sf, max_length=None):
    return TK.masked_examples(chat_rows(spark, sf), max_length, keep=("conv_id", "turn", "category", "source"))


def _ids_md5(c: str):
    return F.md5(F.array_join(F.col(c), ","))


def _masked_digest(m):
    return m.select("conv_id", "turn", F.size("input_ids").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x != D.IGNORE_INDEX)).alias("n_answer_tokens"),
                    _ids_md5("input_ids").alias("ids_md5"), _ids_md5("labels").alias("labels_md5"),
                    _ids_md5("attention_mask").alias("mask_md5"))


def q_masked_sequences(spark, sf):
    return _masked_digest(masked(spark, sf))


def q_masked_sequences_cut(spark, sf):
    """The same, right-truncated to MAX_LENGTH, which here is the feature."""
    return _masked_digest(masked(spark, sf, MAX_LENGTH))


def _sql_cp(s: str) -> str:
    return f"list_transform(string_split({s}, ''), lambda c: unicode(c))"


SQL_MASKED = f"""m0 AS (
  SELECT conv_id, turn, {_sql_cp(sql_render('question'))} AS p, {_sql_cp(f"answer || '{D.IM_END}'")} AS a
  FROM rows WHERE answer IS NOT NULL),
m AS (
  SELECT conv_id, turn, list_concat(p, a) AS input_ids,
         list_concat(list_transform(p, lambda x: -100), a) AS labels,
         list_transform(list_concat(p, a), lambda x: 1) AS attention_mask
  FROM m0)"""
SQL_MASKED_CUT = SQL_MASKED + f""", cut AS (
  SELECT conv_id, turn, list_slice(input_ids, 1, {MAX_LENGTH}) AS input_ids, list_slice(labels, 1, {MAX_LENGTH}) AS labels,
         list_slice(attention_mask, 1, {MAX_LENGTH}) AS attention_mask FROM m)"""

_SQL_MASKED_DIGEST = """
SELECT conv_id, turn, CAST(len(input_ids) AS INTEGER) AS n_tokens,
       CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_answer_tokens,
       md5(array_to_string(input_ids, ',')) AS ids_md5, md5(array_to_string(labels, ',')) AS labels_md5,
       md5(array_to_string(attention_mask, ',')) AS mask_md5
FROM """
register("masked_sequences", f"WITH {SQL_ROWS}, {SQL_MASKED}{_SQL_MASKED_DIGEST} m")(q_masked_sequences)
register("masked_sequences_cut", f"WITH {SQL_ROWS}, {SQL_MASKED_CUT}{_SQL_MASKED_DIGEST} cut")(q_masked_sequences_cut)


# ---------------------------------------------------------------- P5
def q_pad_batches(spark, sf):
    p = TK.pad_batches(masked(spark, sf), BATCH, ["conv_id", "turn"], pad_id=0)
    return p.select("conv_id", "turn", "batch", F.size("input_ids").alias("padded_len"),
                    _ids_md5("input_ids").alias("ids_md5"), _ids_md5("attention_mask").alias("mask_md5"),
                    _ids_md5("labels").alias("labels_md5"))


register("pad_batches", f"""WITH {SQL_ROWS}, {SQL_MASKED},
b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS batch FROM m),
mx AS (SELECT batch, CAST(ceil(max(len(input_ids)) / {D.PAD_MULTIPLE}) * {D.PAD_MULTIPLE} AS INTEGER) AS tgt
       FROM b GROUP BY batch),
p AS (SELECT b.*, tgt - len(input_ids) AS pad FROM b JOIN mx USING (batch))
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch, tgt AS padded_len,
  md5(array_to_string(list_concat(input_ids, list_transform(range(pad), lambda x: 0)), ',')) AS ids_md5,
  md5(array_to_string(list_concat(attention_mask, list_transform(range(pad), lambda x: 0)), ',')) AS mask_md5,
  md5(array_to_string(list_concat(labels, list_transform(range(pad), lambda x: -100)), ',')) AS labels_md5
FROM p JOIN mx USING (batch)""")(q_pad_batches)


# ---------------------------------------------------------------- P7
def q_split_list(spark, sf):
    docs = table(spark, sf, "documents")
    parts = split_list("text", ",")
    return docs.select("doc_id", F.size(parts).alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


register("split_list", f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','),
             lambda x: regexp_replace(x, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')), lambda x: x <> '') AS parts
           FROM documents)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM s""")(q_split_list)


# ---------------------------------------------------------------- P8
def q_token_predictions(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select("vec_id", TK.argmax("embedding").alias("argmax"))


register("token_predictions", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings
""")(q_token_predictions)

