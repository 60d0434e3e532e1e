"""Registered cleaning queries (C1-C14, C25) on ``documents``,
``conversations``, ``labels`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve.functions.text import (
    effective_chars, line_repetition_ratio, normalize_key, strip_ws,
)
from chatsieve.operators import clean as C
from chatsieve.operators.dataset import augment
from chatsieve.plans.common import SQL_WS, r6, register, table

# Test vocabularies.
LICENSE_PHRASES = ["License", "license"]
PERSONAL_MARKERS = ["@"]
REPEAT_N = 20
REPEAT_MAX = 0.5
MIN_CHARS = 20

SQL_NORM = f"lower(regexp_replace(text, '{SQL_WS}+', '', 'g'))"
SQL_EFF = "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))"
SQL_MEANINGLESS = ("regexp_full_match(regexp_replace(text, '" + SQL_WS + "+', '', 'g'), "
                   "'(|[^\\p{L}]*|[A-Za-z0-9_#\\-./]*[0-9][A-Za-z0-9_#\\-./]*)')")


def sql_repetition(text_sql: str, n: int) -> str:
    s = f"regexp_replace({text_sql}, '{SQL_WS}+', '', 'g')"
    grams = f"list_transform(range(1, length({s}) - {n} + 2), lambda i: substring({s}, i, {n}))"
    return (f"CASE WHEN length({s}) >= {n} THEN 1.0 - len(list_distinct({grams})) / len({grams}) "
            f"ELSE 0.0 END")


# ---------------------------------------------------------------- C1
def q_union_parts(spark, sf):
    parts = {
        "conversations": table(spark, sf, "conversations").select(
            F.col("conv_id").alias("id"), "text"),
        "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
        "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
    }
    u = C.union_parts(parts)
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum(F.char_length("text")).cast("long").alias("n_chars"))


register("union_parts", """
SELECT part, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT 'conversations' AS part, text FROM conversations
  UNION ALL SELECT 'documents', text FROM documents
  UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY part""")(q_union_parts)


# ---------------------------------------------------------------- C2
def q_drop_exact_duplicates(spark, sf):
    docs = table(spark, sf, "documents")
    return C.drop_exact_duplicates(docs, "doc_id", ["text"]).select("doc_id", "lang", "source")


register("drop_exact_duplicates", """
SELECT doc_id, lang, source FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""")(q_drop_exact_duplicates)


# ---------------------------------------------------------------- C3
def q_keep_label(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    good = C.keep_label(table(spark, sf, "labels"), 1, "quality").select("doc_id")
    return docs.join(good, "doc_id", "left_semi")


register("keep_label", """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")(q_keep_label)


# ---------------------------------------------------------------- C4
def q_qa_pairs(spark, sf):
    pairs = C.extract_qa_pairs(table(spark, sf, "conversations"))
    return pairs.select("conv_id", "turn", F.char_length("question").alias("q_len"),
                        F.char_length("answer").alias("a_len"), F.md5("answer").alias("a_md5"))


register("qa_pairs", """
SELECT q.conv_id, q.turn, CAST(length(q.text) AS INTEGER) AS q_len, CAST(length(a.text) AS INTEGER) AS a_len,
       md5(a.text) AS a_md5
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")(q_qa_pairs)


# ---------------------------------------------------------------- C5 + C7
def q_normalize_text(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", F.md5(C.detokenize("text")).alias("detok_md5"),
                       effective_chars("text").alias("eff_chars"),
                       F.char_length(strip_ws("text")).alias("nows_chars"))


register("normalize_text", f"""
SELECT conv_id, turn,
  md5(regexp_replace(regexp_replace(text, '(\\p{{Han}})[ \\t]+(\\p{{Han}})', '\\1\\2', 'g'),
                     '(\\p{{Han}})[ \\t]+(\\p{{Han}})', '\\1\\2', 'g')) AS detok_md5,
  CAST({SQL_EFF} AS INTEGER) AS eff_chars,
  CAST(length(regexp_replace(text, '{SQL_WS}+', '', 'g')) AS INTEGER) AS nows_chars
FROM conversations""")(q_normalize_text)


# ---------------------------------------------------------------- C6
def q_context_text(spark, sf):
    ctx = C.context_text(table(spark, sf, "conversations"))
    return ctx.select("conv_id", "turn", "context_turns", F.md5("context").alias("context_md5"),
                      F.char_length("context").alias("context_len"))


register("context_text", """
WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn > 0),
ctx AS (
  SELECT t.conv_id, t.turn, count(*) AS context_turns,
         string_agg(c.role || ': ' || c.text, chr(10) ORDER BY c.turn) AS context
  FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn < t.turn
  GROUP BY t.conv_id, t.turn)
SELECT conv_id, turn, CAST(context_turns AS INTEGER) AS context_turns, md5(context) AS context_md5,
       CAST(length(context) AS INTEGER) AS context_len
FROM ctx""")(q_context_text)


# ---------------------------------------------------------------- C7
def q_min_effective_chars(spark, sf):
    docs = table(spark, sf, "documents")
    kept = C.min_effective_chars(docs, "text", MIN_CHARS)
    return kept.select("doc_id", effective_chars("text").alias("eff_chars"))


register("min_effective_chars", f"""
SELECT doc_id, CAST({SQL_EFF} AS INTEGER) AS eff_chars FROM documents WHERE {SQL_EFF} >= {MIN_CHARS}
""")(q_min_effective_chars)


# ---------------------------------------------------------------- C8
def q_drop_duplicate_qa(spark, sf):
    pairs = C.extract_qa_pairs(table(spark, sf, "conversations")) \
        .withColumn("pair_key", F.struct("conv_id", "turn"))
    return C.drop_duplicate_qa(pairs, "pair_key").select("conv_id", "turn")


register("drop_duplicate_qa", f"""
WITH p AS (
  SELECT q.conv_id, q.turn, lower(regexp_replace(q.text, '{SQL_WS}+', '', 'g')) AS nq,
         lower(regexp_replace(a.text, '{SQL_WS}+', '', 'g')) AS na
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY nq, na ORDER BY conv_id, turn) AS k FROM p) WHERE k = 1
""")(q_drop_duplicate_qa)


# ---------------------------------------------------------------- C9
def q_meaningless(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", C.is_meaningless("text").alias("meaningless"))


register("meaningless", f"""
SELECT doc_id, coalesce({SQL_MEANINGLESS}, true) AS meaningless FROM documents
""")(q_meaningless)


# ---------------------------------------------------------------- C10
def q_drop_by_phrase(spark, sf):
    docs = table(spark, sf, "documents")
    return C.drop_by_phrase(docs, "text", LICENSE_PHRASES).select("doc_id", "lang")


register("drop_by_phrase", """
SELECT doc_id, lang FROM documents WHERE NOT (contains(text, 'License') OR contains(text, 'license'))
""")(q_drop_by_phrase)


# ---------------------------------------------------------------- C11
def q_repetition(spark, sf):
    docs = table(spark, sf, "documents")
    return C.with_repetition(docs.select("doc_id", "text"), "text", REPEAT_N).select("doc_id", r6(F.col("repetition")).alias("repetition"))


# One row per character; lead() builds the n-gram that starts there.
SQL_GRAMS = f"""bare AS (
  SELECT doc_id, string_split(regexp_replace(text, '{SQL_WS}+', '', 'g'), '') AS cs FROM documents),
ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM bare),
grams AS (
  SELECT doc_id, c || {' || '.join(f"lead(c, {i}) OVER w" for i in range(1, REPEAT_N))} AS g
  FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (
  SELECT doc_id, 1.0 - count(DISTINCT g) / count(g) AS repetition FROM grams WHERE g IS NOT NULL GROUP BY doc_id),
all_rep AS (SELECT doc_id, source, coalesce(repetition, 0.0) AS repetition FROM documents LEFT JOIN rep USING (doc_id))"""
register("repetition", f"WITH {SQL_GRAMS} SELECT doc_id, round(repetition, 6) AS repetition FROM all_rep")(q_repetition)


def q_drop_repetitive(spark, sf):
    docs = table(spark, sf, "documents")
    return C.drop_repetitive(docs, "text", REPEAT_N, REPEAT_MAX).select("doc_id", "source")


register("drop_repetitive", f"WITH {SQL_GRAMS} SELECT doc_id, source FROM all_rep WHERE repetition <= {REPEAT_MAX}")(
    q_drop_repetitive)


def q_line_repetition(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", r6(line_repetition_ratio("text")).alias("line_repetition"))


SQL_LINE_REP = "(1.0 - len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))))"

register("line_repetition", f"""
SELECT doc_id, round({SQL_LINE_REP}, 6) AS line_repetition FROM documents
""")(q_line_repetition)


# ---------------------------------------------------------------- C12
def q_drop_flagged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    flags = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return C.drop_flagged(docs, flags, "doc_id")


register("drop_flagged", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")(q_drop_flagged)


# ---------------------------------------------------------------- C13
FUNNEL_ORDER = ["empty", "too_short", "duplicate", "meaningless", "license", "repetitive", "flagged", "kept"]


def funnel_tagged(spark, sf):
    docs = table(spark, sf, "documents")
    flags = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id", F.lit(True).alias("flag"))
    d = C.mark_first_of_duplicates(docs, normalize_key("text"), "doc_id")
    d = d.join(flags, "doc_id", "left")
    eff = effective_chars("text")
    from chatsieve.functions.text import contains_any, literal_array
    rules = [
        ("empty", eff == 0),
        ("too_short", eff < MIN_CHARS),
        ("duplicate", ~F.col("is_first")),
        ("meaningless", C.is_meaningless("text")),
        ("license", contains_any(F.col("text"), literal_array(LICENSE_PHRASES))),
        ("repetitive", line_repetition_ratio("text") > REPEAT_MAX),
        ("flagged", F.col("flag")),
    ]
    return C.cleaning_funnel(d, rules)


def q_cleaning_funnel(spark, sf):
    return C.funnel_counts(funnel_tagged(spark, sf), order=FUNNEL_ORDER)


register("cleaning_funnel", f"""
WITH d AS (
  SELECT doc_id, text, {SQL_EFF} AS eff, {SQL_NORM} AS nk FROM documents),
f AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY nk),
t AS (
  SELECT CASE
    WHEN eff = 0 THEN 'empty'
    WHEN eff < {MIN_CHARS} THEN 'too_short'
    WHEN d.doc_id NOT IN (SELECT doc_id FROM f) THEN 'duplicate'
    WHEN coalesce({SQL_MEANINGLESS}, true) THEN 'meaningless'
    WHEN contains(text, 'License') OR contains(text, 'license') THEN 'license'
    WHEN {SQL_LINE_REP} > {REPEAT_MAX} THEN 'repetitive'
    WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'flagged'
    ELSE 'kept' END AS reason
  FROM d)
SELECT reason, count(*) AS n,
  CAST(list_position({FUNNEL_ORDER!r}, reason) AS INTEGER) AS step
FROM t GROUP BY reason""".replace('"', "'"))(q_cleaning_funnel)


# ---------------------------------------------------------------- C14
def q_sample_weight(spark, sf):
    docs = table(spark, sf, "documents")
    return C.sample_weight(docs, "text", PERSONAL_MARKERS, 0.5).select("doc_id", "weight")


register("sample_weight", """
SELECT doc_id, CAST(CASE WHEN contains(text, '@') THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM documents
""")(q_sample_weight)


# ---------------------------------------------------------------- C15
TEMPLATES = [
    ("en", "What does source {slot} say?", "Source {slot} is an English text."),
    ("de", "Was sagt Quelle {slot}?", "Quelle {slot} ist ein deutscher Text."),
    ("fr", "Que dit la source {slot} ?", "La source {slot} est un texte français."),
    ("es", "¿Qué dice la fuente {slot}?", "La fuente {slot} es un texto en español."),
]


def q_augment(spark, sf):
    base = C.extract_qa_pairs(table(spark, sf, "conversations"))
    templates = spark.createDataFrame(TEMPLATES, "lang string, question_template string, answer_template string")
    slots = table(spark, sf, "documents").select("lang", F.col("source").alias("slot")).distinct()
    aug = augment(base, templates, slots, on="lang")
    return aug.groupBy("source", F.md5(F.concat_ws("|", "question", "answer")).alias("row_md5")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _sql_templates() -> str:
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in t) + ")" for t in TEMPLATES)
    return f"(VALUES {rows}) AS tpl(lang, question_template, answer_template)"


register("augment", f"""
WITH base AS (
  SELECT q.text AS question, a.text AS answer, 'raw_cleaned' AS source
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'),
filled AS (
  SELECT replace(question_template, '{{slot}}', d.source) AS question,
         replace(answer_template, '{{slot}}', d.source) AS answer, 'rule_augmented' AS source
  FROM {_sql_templates()} JOIN (SELECT DISTINCT lang, source FROM documents) d USING (lang)),
u AS (SELECT * FROM base UNION ALL SELECT * FROM filled)
SELECT source, md5(concat_ws('|', question, answer)) AS row_md5, count(*) AS n FROM u GROUP BY ALL
""")(q_augment)


# ---------------------------------------------------------------- C25
def q_holdout_contained(spark, sf):
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark")
    return C.flag_contained_holdout(docs, bench, "doc_id", "text", "item_id", "text")


register("holdout_contained", """
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")(q_holdout_contained)


def q_exclude_holdout(spark, sf):
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark")
    kept = C.exclude_contained_holdout(docs, bench, "doc_id", "text", "item_id", "text")
    # exact (normalised) equality with a benchmark item as well
    kept = C.exclude_holdout(kept, bench, "text", "text")
    return kept.select("doc_id")


register("exclude_holdout", f"""
SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
  AND {SQL_NORM} NOT IN (SELECT lower(regexp_replace(text, '{SQL_WS}+', '', 'g')) FROM benchmark)
""")(q_exclude_holdout)
