"""Registered metric queries (E12-E19, E21, E22).

* Character BLEU: answers scored against their questions (per scene corpus).
* BERTScore: ``embeddings`` as token vectors; consecutive blocks of 16
  vectors form a sample, even ids are candidate tokens and odd ids
  reference tokens (every row is used).
* Win rate / improvement / comparison: per-question rule scores of the two
  answer runs of ``plans.scoring``.
* Token accuracy: the masked sequences of ``plans.sequences``.
* Rubric roll-up: ``events`` scores per event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve.operators import metrics as M
from chatsieve.operators import tokens as TK
from chatsieve.operators.clean import extract_qa_pairs
from chatsieve.operators.dataset import classify
from chatsieve.operators.rules import rule_pass_columns, score_columns, score_outputs
from chatsieve.plans.common import SQL_WS, TEST_CATEGORIES, TEST_SCENES, r6, register, sql_scene_case, table
from chatsieve.plans import scoring as S
from chatsieve.plans import sequences as SQ

SAMPLE_BLOCK = 16


# ---------------------------------------------------------------- E12
def q_positional_align(spark, sf):
    """Equal sizes (strict): the documents against themselves in reverse order."""
    docs = table(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).scalar()
    refs = docs.select((last - F.col("doc_id")).alias("pos"), F.col("text").alias("ref"))
    preds = docs.select(F.col("doc_id").alias("pos"), F.col("text").alias("pred"))
    j = M.positional_align(preds, refs, "pos")
    return j.select("pos", F.md5("pred").alias("pred_md5"), F.md5("ref").alias("ref_md5"))


register("positional_align", """
SELECT d.doc_id AS pos, md5(d.text) AS pred_md5, md5(r.text) AS ref_md5
FROM documents d JOIN documents r ON r.doc_id = (SELECT max(doc_id) FROM documents) - d.doc_id""")(q_positional_align)


# ---------------------------------------------------------------- E13 / E14
def q_char_bleu(spark, sf):
    pairs = extract_qa_pairs(table(spark, sf, "conversations")) \
        .withColumn("category", classify("question", TEST_SCENES, "other"))
    b = M.corpus_char_bleu(pairs, "answer", "question", ["conv_id", "turn"], by=["category"])
    return b.select("category", "num_rows", "hyp_len", "ref_len",
                    *[f"num{n}" for n in range(1, 5)], *[f"den{n}" for n in range(1, 5)],
                    r6(F.col("bleu")).alias("bleu"))


SQL_QA_BLEU = f"""qa AS (
  SELECT (q.conv_id, q.turn) AS row_id, {sql_scene_case('q.text')} AS category,
         regexp_replace(a.text, '{SQL_WS}+', '', 'g') AS h, regexp_replace(q.text, '{SQL_WS}+', '', 'g') AS r
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

SQL_RUNS_BLEU = f"""qa AS (
  SELECT (q.conv_id, q.turn) AS row_id, 'all' AS category,
         regexp_replace(a.text, '{SQL_WS}+', '', 'g') AS h, regexp_replace(b.text, '{SQL_WS}+', '', 'g') AS r
  FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  JOIN conversations b ON b.conv_id = q.conv_id AND b.turn = q.turn + 3 AND b.role = 'assistant'
  WHERE q.role = 'user')"""


def _sql_bleu(qa_cte: str = SQL_QA_BLEU) -> str:
    p = [f"CASE WHEN num{n} > 0 THEN num{n} / den{n} WHEN hyp_len > 1 THEN "
         f"ln(hyp_len) / (5.0 * pow(2.0, {' + '.join(f'CAST(num{m} = 0 AS INTEGER)' for m in range(1, n + 1))})) / den{n} END"
         for n in range(1, 5)]
    bad = " OR ".join(f"coalesce(p{n}, 0) <= 0" for n in range(1, 5))
    return f"""WITH {qa_cte},
grams AS (
  SELECT category, row_id, n, 'h' AS side, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substring(h, i, n))) AS g
  FROM qa, (VALUES (1), (2), (3), (4)) t(n)
  UNION ALL
  SELECT category, row_id, n, 'r', unnest(list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n)))
  FROM qa, (VALUES (1), (2), (3), (4)) t(n)),
clip AS (
  SELECT category, n, sum(least(ch, cr)) AS m FROM (
    SELECT category, row_id, n, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr
    FROM grams GROUP BY ALL) GROUP BY ALL),
nums AS (
  SELECT category, {', '.join(f"CAST(coalesce(sum(m) FILTER (WHERE n = {n}), 0) AS BIGINT) AS num{n}" for n in range(1, 5))}
  FROM clip GROUP BY category),
dens AS (
  SELECT category, count(*) AS num_rows, CAST(sum(length(h)) AS BIGINT) AS hyp_len, CAST(sum(length(r)) AS BIGINT) AS ref_len,
         {', '.join(f"CAST(sum(greatest(1, length(h) - {n} + 1)) AS BIGINT) AS den{n}" for n in range(1, 5))}
  FROM qa GROUP BY category),
c AS (SELECT d.*, {', '.join(f"coalesce(num{n}, 0) AS num{n}" for n in range(1, 5))}
      FROM dens d LEFT JOIN nums USING (category)),
pp AS (SELECT *, {', '.join(f"{p[n - 1]} AS p{n}" for n in range(1, 5))},
              CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1 - ref_len / hyp_len) END AS bp
       FROM c)
SELECT category, num_rows, hyp_len, ref_len, num1, num2, num3, num4, den1, den2, den3, den4,
  round(CASE WHEN num1 = 0 THEN 0.0 WHEN {bad} THEN 0.0
             ELSE bp * exp(0.25 * (ln(p1) + ln(p2) + ln(p3) + ln(p4))) END, 6) AS bleu
FROM pp"""


register("char_bleu", _sql_bleu())(q_char_bleu)


def q_char_bleu_runs(spark, sf):
    """Corpus BLEU of one answer run against another (hypothesis: the next
    answer, reference: the answer two turns later), as when a tuned model's
    outputs are scored against reference answers."""
    conv = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    hyp = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    ref = conv.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("ref"))
    users = table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn")
    pairs = users.join(hyp, ["conv_id", "turn"]).join(ref, ["conv_id", "turn"])
    b = M.corpus_char_bleu(pairs, "hyp", "ref", ["conv_id", "turn"])
    return b.select(F.lit("all").alias("category"), "num_rows", "hyp_len", "ref_len",
                    *[f"num{n}" for n in range(1, 5)], *[f"den{n}" for n in range(1, 5)],
                    r6(F.col("bleu")).alias("bleu"))


register("char_bleu_runs", _sql_bleu(SQL_RUNS_BLEU))(q_char_bleu_runs)


# ---------------------------------------------------------------- E15
def token_table(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select(F.floor(F.col("vec_id") / SAMPLE_BLOCK).cast("long").alias("sid"),
                      F.when(F.col("vec_id") % 2 == 0, F.lit("cand")).otherwise(F.lit("ref")).alias("side"),
                      F.col("vec_id").alias("tok"), F.col("embedding").alias("vec"))


def q_bertscore(spark, sf):
    s = M.bertscore(token_table(spark, sf))
    return s.select("sid", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("f1")).alias("f1"))


SQL_BERT = f"""t AS (
  SELECT vec_id // {SAMPLE_BLOCK} AS sid, vec_id % 2 = 0 AS is_cand, vec_id AS tok,
         CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv
  FROM embeddings),
sims AS (
  SELECT c.sid, c.tok AS ct, r.tok AS rt, list_dot_product(c.v, r.v) / (c.nv * r.nv) AS cos
  FROM t c JOIN t r ON c.sid = r.sid AND c.is_cand AND NOT r.is_cand),
pr AS (SELECT sid, avg(m) AS precision FROM (SELECT sid, ct, max(cos) AS m FROM sims GROUP BY sid, ct) GROUP BY sid),
rc AS (SELECT sid, avg(m) AS recall FROM (SELECT sid, rt, max(cos) AS m FROM sims GROUP BY sid, rt) GROUP BY sid),
s AS (SELECT sid, precision, recall,
             CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM pr JOIN rc USING (sid))"""

register("bertscore", f"""WITH {SQL_BERT}
SELECT sid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s
""")(q_bertscore)


def q_bertscore_means(spark, sf):
    m = M.bertscore_means(M.bertscore(token_table(spark, sf)))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("precision_mean", "recall_mean", "f1_mean")], "num_samples")


register("bertscore_means", f"""WITH {SQL_BERT}
SELECT round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean,
       round(avg(f1), 6) AS f1_mean, count(*) AS num_samples FROM s""")(q_bertscore_means)


# ---------------------------------------------------------------- E16 / E17
def run_scores(spark, sf):
    return score_outputs(S.eval_items(spark, sf), S.two_run_outputs(spark, sf), use_gold_category=False,
                         key=S.KEY, categories=TEST_CATEGORIES)


def runs_side_by_side(spark, sf):
    """One row per question with both runs' rule score, must-have pass and
    forbidden hit: one scoring pass and one shuffle (a pivot on the run)."""
    items = S.eval_items(spark, sf)
    j = items.join(S.two_run_outputs(spark, sf), S.KEY)
    sc = score_columns(F.col("output"), F.col("must_have_any"), F.col("forbidden"), F.col("category"),
                       False, TEST_CATEGORIES)
    rp = rule_pass_columns(F.col("output"), F.col("must_have_any"),
                           F.array(*[F.lit(t) for t in S.PASS_FORBIDDEN]))
    scored = j.select(*S.KEY, "run", sc["rule_score"].alias("rule"),
                      rp["must_pass"].cast("double").alias("must"), rp["forbidden_hit"].cast("double").alias("forb"))
    return scored.groupBy(*S.KEY).pivot("run", ["next", "later"]).agg(
        F.first("rule").alias("rule"), F.first("must").alias("must"), F.first("forb").alias("forb"))


def q_win_rate(spark, sf):
    piv = runs_side_by_side(spark, sf)
    w = M.win_rate(piv, "next_rule", "later_rule", with_means=True)
    imp = M.improvement(F.col("mean_next_rule"), F.col("mean_later_rule"))
    return w.select("win", "tie", "lose", "total",
                    *[r6(F.col(c)).alias(c) for c in ("win_rate", "tie_rate", "lose_rate")],
                    r6(imp["abs_improvement"]).alias("abs_improvement"),
                    r6(imp["rel_improvement_pct"]).alias("rel_improvement_pct"))


SQL_RUN_SCORES = S._sql_scored(S._sql_outputs(1, "next") + " UNION ALL " + S._sql_outputs(3, "later")) + """,
rs AS (SELECT run, conv_id, turn, must_hit_count / greatest(1, must_total) AS rule_score FROM scored)"""

register("win_rate", SQL_RUN_SCORES + """,
p AS (SELECT a.rule_score AS a, b.rule_score AS b FROM rs a JOIN rs b USING (conv_id, turn)
      WHERE a.run = 'next' AND b.run = 'later'),
w AS (SELECT CAST(sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS BIGINT) AS win,
             CAST(sum(CASE WHEN b = a THEN 1 ELSE 0 END) AS BIGINT) AS tie,
             CAST(sum(CASE WHEN b < a THEN 1 ELSE 0 END) AS BIGINT) AS lose, count(*) AS total FROM p),
m AS (SELECT avg(rule_score) FILTER (WHERE run = 'next') AS a, avg(rule_score) FILTER (WHERE run = 'later') AS b FROM rs)
SELECT win, tie, lose, total, round(win / total, 6) AS win_rate, round(tie / total, 6) AS tie_rate,
       round(lose / total, 6) AS lose_rate, round(b - a, 6) AS abs_improvement,
       round((b - a) / a * 100, 6) AS rel_improvement_pct
FROM w, m""")(q_win_rate)


# ---------------------------------------------------------------- E18
# The first column is the mean rule score here, so that is its label.
COMPARED = ["Average Rule Score", "Must-have Pass", "1 - Forbidden Hit", "Win Rate"]


def q_comparison_table(spark, sf):
    piv = runs_side_by_side(spark, sf)
    # every figure from one aggregate over the side-by-side table
    row = M.win_rates(piv.agg(
        *M.win_rate_aggs("next_rule", "later_rule"),
        *[F.avg(f"{r}_{m}").alias(f"{r}_{m}") for r in ("next", "later") for m in ("rule", "must", "forb")]))
    per_run = row.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("run"), F.col(f"{r}_rule").alias("avg_rule_score"),
                 F.col(f"{r}_must").alias("must_have_pass_rate"), F.col(f"{r}_forb").alias("forbidden_hit_rate"),
                 F.col("win_rate").alias("win_rate"))
        for r in ("next", "later")])))
    t = M.comparison_table(per_run, baseline_run="next", bert_f1="avg_rule_score", labels=COMPARED)
    return t.select("run", "metric", r6(F.col("value")).alias("value"))


register("comparison_table", SQL_RUN_SCORES + f""",
items2 AS (SELECT conv_id, turn, groups FROM items),
outs2 AS ({S._sql_outputs(1, "next")} UNION ALL {S._sql_outputs(3, "later")}),
j2 AS (SELECT i.groups, o.run, o.output FROM items2 i JOIN outs2 o USING (conv_id, turn)),
rates AS (SELECT run,
  avg(CAST(len(groups) = 0 OR len(list_filter(groups, lambda g: len(list_filter(g, lambda k: contains(output, k))) = 0)) = 0 AS DOUBLE)) AS must,
  avg(CAST(len(list_filter({S._sql_list(S.PASS_FORBIDDEN)}, lambda k: contains(output, k))) > 0 AS DOUBLE)) AS forb
  FROM j2 GROUP BY run),
q AS (SELECT run, avg(rule_score) AS quality FROM rs GROUP BY run),
p AS (SELECT a.rule_score AS a, b.rule_score AS b FROM rs a JOIN rs b USING (conv_id, turn)
      WHERE a.run = 'next' AND b.run = 'later'),
w AS (SELECT sum(CASE WHEN b > a THEN 1 ELSE 0 END) / count(*) AS win FROM p),
wide AS (SELECT q.run, q.quality, r.must, 1 - r.forb AS nf,
                CASE WHEN q.run = 'next' THEN 0.5 ELSE (SELECT win FROM w) END AS wr
         FROM q JOIN rates r USING (run))
SELECT run, 'Average Rule Score' AS metric, round(quality, 6) AS value FROM wide
UNION ALL SELECT run, 'Must-have Pass', round(must, 6) FROM wide
UNION ALL SELECT run, '1 - Forbidden Hit', round(nf, 6) FROM wide
UNION ALL SELECT run, 'Win Rate', round(wr, 6) FROM wide""")(q_comparison_table)


# ---------------------------------------------------------------- E19
def q_token_accuracy(spark, sf):
    m = SQ.masked(spark, sf)
    a = M.masked_token_accuracy(m, "input_ids", "labels", by=["category"])
    return a.select("category", "correct", "total", r6(F.col("mean_token_accuracy")).alias("mean_token_accuracy"))


register("token_accuracy", f"""WITH {SQ.SQL_ROWS}, {SQ.SQL_MASKED},
mc AS (SELECT m.*, {sql_scene_case('r.question')} AS category
       FROM m JOIN rows r USING (conv_id, turn)),
c AS (SELECT category,
        len(list_filter(range(1, len(input_ids)), lambda i: labels[i + 1] <> -100)) AS tot,
        len(list_filter(range(1, len(input_ids)), lambda i: labels[i + 1] <> -100 AND input_ids[i] = labels[i + 1])) AS cor
      FROM mc)
SELECT category, CAST(sum(cor) AS BIGINT) AS correct, CAST(sum(tot) AS BIGINT) AS total,
       round(CASE WHEN sum(tot) > 0 THEN sum(cor) / sum(tot) ELSE 0.0 END, 6) AS mean_token_accuracy
FROM c GROUP BY category""")(q_token_accuracy)


def q_score_accuracy(spark, sf):
    """Vectors as scores: two chunks of 64 tokens a position, ten positions a row; a label is what the first chunk
    alone predicts at the place before, every row's first label is masked."""
    v = F.col("vec_id")
    scores = table(spark, sf, "embeddings").select(
        F.floor(v / 20).alias("row"), F.floor(v % 20 / 2).alias("pos"), (v % 2 * 64).cast("int").alias("first"),
        F.col("embedding").alias("scores"))
    preds = TK.chunked_predictions(scores, ["row", "pos"])
    nxt = scores.where("first = 0").select("row", (F.col("pos") + 1).alias("pos"), TK.argmax("scores").alias("label"))
    firsts = scores.where("first = 0 and pos = 0").select("row", "pos", F.lit(-100).alias("label"))
    labels = nxt.unionByName(firsts).withColumn("parity", F.col("row") % 2)
    a = M.positional_token_accuracy(preds, labels, "row", by=["parity"])
    return a.select("parity", "correct", "total", r6(F.col("mean_token_accuracy")).alias("mean_token_accuracy"))


register("score_accuracy", """
WITH s AS (SELECT vec_id // 20 AS row, vec_id % 20 // 2 AS pos, vec_id % 2 AS chunk, list_max(embedding) AS top,
                  list_position(embedding, list_max(embedding)) - 1 AS place FROM embeddings),
p AS (SELECT row, pos, first(chunk * 64 + place ORDER BY top DESC, chunk) AS pred FROM s GROUP BY row, pos),
l AS (SELECT row, pos + 1 AS pos, place AS label FROM s WHERE chunk = 0)
SELECT CAST(l.row % 2 AS BIGINT) AS parity, count(*) FILTER (WHERE pred = label) AS correct, count(*) AS total,
       round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS mean_token_accuracy
FROM l JOIN p ON p.row = l.row AND p.pos + 1 = l.pos GROUP BY l.row % 2""")(q_score_accuracy)


# ---------------------------------------------------------------- E21
def q_rubric_rollup(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_type", F.col("value").alias("score_value"),
        F.get_json_object("props", "$.k").cast("double").alias("score_k"))
    r = M.rubric_rollup(ev, ["score_value", "score_k"], by=["event_type"])
    return r.select("event_type", "dimension", r6(F.col("mean_score")).alias("mean_score"), "n")


register("rubric_rollup", """
SELECT event_type, 'score_value' AS dimension, round(avg(value), 6) AS mean_score, count(value) AS n
FROM events GROUP BY event_type
UNION ALL
SELECT event_type, 'score_k', round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6),
       count(CAST(json_extract_string(props, '$.k') AS DOUBLE))
FROM events GROUP BY event_type""")(q_rubric_rollup)


# ---------------------------------------------------------------- E22
def q_pair_answers(spark, sf):
    outs = S.two_run_outputs(spark, sf).select(
        "conv_id", "turn", "run", F.col("output").alias("answer"))
    p = M.pair_answers(outs, ["conv_id", "turn"], "run", "answer", ["next", "later"])
    return p.select("conv_id", "turn", F.md5("next_answer").alias("next_md5"), F.md5("later_answer").alias("later_md5"))


register("pair_answers", f"""WITH o AS ({S._sql_outputs(1, "next")} UNION ALL {S._sql_outputs(3, "later")})
SELECT a.conv_id, a.turn, md5(a.output) AS next_md5, md5(b.output) AS later_md5
FROM o a JOIN o b USING (conv_id, turn) WHERE a.run = 'next' AND b.run = 'later'""")(q_pair_answers)
