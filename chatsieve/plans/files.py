"""Registered sink-to-source queries (S1, S3, S7, S9, E12): the given tables are
written to the cluster's shared folder by the library's writers and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve.operators import metrics as M
from chatsieve.operators.clean import extract_qa_pairs
from chatsieve.plans.common import SQL_WS, register, table
from chatsieve.session import shared_path
from chatsieve.sources import io as IO

LINE_BREAKS = r"[\r\n]+"


# ---------------------------------------------------------------- S3 / E12
def q_line_files(spark, sf):
    """Questions and answers in two files of lines, paired again by the place of their lines."""
    qa = extract_qa_pairs(table(spark, sf, "conversations"))
    order = F.struct("conv_id", "turn").alias("order")
    read = {}
    for c in ("question", "answer"):
        line = F.concat_ws("|", "conv_id", "turn", F.regexp_replace(c, LINE_BREAKS, " "))
        path = shared_path(spark, f"lines-{c}")
        IO.write_lines(qa.select(order, line.alias("line")), path)
        read[c] = IO.read_ordered_lines(spark, path, text_col=c)
    both = M.positional_align(read["question"], read["answer"], "pos")
    ids = {c: F.substring_index(c, "|", 2) for c in read}
    chars = {c: F.char_length(F.regexp_replace(F.substring(c, F.char_length(ids[c]) + 2, F.char_length(c)),
                                               r"(?U)[\s\x1c-\x1f]+", "")) for c in read}
    return both.select("pos", *[x.alias(f"{c}_id") for c, x in ids.items()], *[x.alias(f"{c}_chars") for c, x in chars.items()])


register("line_files", f"""
SELECT row_number() OVER (ORDER BY q.conv_id, q.turn) - 1 AS pos, q.conv_id || '|' || q.turn AS question_id,
       q.conv_id || '|' || q.turn AS answer_id,
       CAST(length(regexp_replace(coalesce(q.text, ''), '{SQL_WS}+', '', 'g')) AS INTEGER) AS question_chars,
       CAST(length(regexp_replace(coalesce(a.text, ''), '{SQL_WS}+', '', 'g')) AS INTEGER) AS answer_chars
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")(q_line_files)


# ---------------------------------------------------------------- S1 / S2 / S7 / S12
def q_located_jsonl(spark, sf):
    """Documents as JSON lines, every 53rd cut off and a blank line after every 41st, read back with line numbers."""
    docs = table(spark, sf, "documents")
    id_ = F.col("doc_id")
    text = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    text = F.when(id_ % 53 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    pair = F.array(F.struct(F.lit(0).alias("sub"), text.alias("line")),
                   *[F.when(id_ % 41 == 0, F.struct(F.lit(1).alias("sub"), F.lit(" ").alias("line")))])
    lines = docs.select("doc_id", F.explode(pair).alias("x")).where("x is not null")
    path = shared_path(spark, "json-lines")
    IO.write_lines(lines.select(F.struct("doc_id", "x.sub").alias("order"), "x.line"), path)
    rows, bad = IO.read_located_jsonl(spark, path, "doc_id long, lang string, source string, n_chars long", per_file=False)
    return rows.select("line_no", F.lit("row").alias("kind"), "doc_id", "lang", "source", "n_chars").unionByName(
        bad.select("line_no", F.lit("malformed").alias("kind"), F.regexp_extract("line", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id")),
        allowMissingColumns=True)


register("located_jsonl", """
WITH l AS (SELECT doc_id, 0 AS sub FROM documents UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 41 = 0),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, sub) AS line_no FROM l)
SELECT line_no, CASE WHEN d.doc_id % 53 = 0 THEN 'malformed' ELSE 'row' END AS kind, d.doc_id,
       CASE WHEN d.doc_id % 53 <> 0 THEN lang END AS lang, CASE WHEN d.doc_id % 53 <> 0 THEN source END AS source,
       CASE WHEN d.doc_id % 53 <> 0 THEN CAST(n_chars AS BIGINT) END AS n_chars
FROM n JOIN documents d ON d.doc_id = n.doc_id WHERE sub = 0""")(q_located_jsonl)


# ---------------------------------------------------------------- S9 / S11
def q_csv_parts(spark, sf):
    """A report as ordered parts of one CSV file: every line's place, and the cells read back from the lines."""
    labels = table(spark, sf, "labels")
    report = labels.select("doc_id", F.concat(F.lit('q="'), F.col("quality").cast("string"), F.lit('", x')).alias("note"),
                           F.when(F.col("toxic") == 1, F.lit("yes")).alias("toxic"))
    path = shared_path(spark, "report")
    IO.write_lines(IO.csv_lines(report.withColumn("order", F.col("doc_id")), "order"), path)
    lines = IO.numbered_lines(spark, path)
    cells = F.from_csv("value", F.lit("a string, b string, c string"), {"quote": '"', "escape": '"'})
    return lines.select("pos", cells.alias("r")).select("pos", F.col("r.a").alias("doc_id"), F.col("r.b").alias("note"),
                                                        F.coalesce("r.c", F.lit("")).alias("toxic"))


register("csv_parts", """
SELECT 0 AS pos, 'doc_id' AS doc_id, 'note' AS note, 'toxic' AS toxic
UNION ALL
SELECT row_number() OVER (ORDER BY doc_id), CAST(doc_id AS VARCHAR), 'q="' || quality || '", x', CASE WHEN toxic = 1 THEN 'yes' ELSE '' END
FROM labels""")(q_csv_parts)
