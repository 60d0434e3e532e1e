"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatsieve.llm import (cross_tokenizer, divergence_audit, exact_dedup, jaccard_join, language_ecoc, license_scan,
                           piece_bpe, pii, pivotal_mix, quality_zstd, token_count, token_orc, weak_rules)
from chatsieve.llm.common import documents

TOKENIZERS = "/opt/tokenizers"  # the folder of the same files, for jobs that take a folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_compression_quality")
def op1(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_zstd.held_out_scores(documents(spark, sf_dir), labels)


@query("op2_jaccard_join")
def op2(spark, sf_dir):
    return jaccard_join.near_components(documents(spark, sf_dir), words=3, num=9, den=10)


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op3(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="max")


@query("op4_quality_rules")
def op4(spark, sf_dir):
    return weak_rules.judge(documents(spark, sf_dir))


def _license_sql() -> str:
    items = [(True, *x) for x in license_scan.BASE] + [(False, *x) for x in license_scan.TEMPLATES]
    rows = [f"('{base}:{label}:{phrase}', '{label}', {base}, {len(phrase.split()) - 1}, {i}, '{a} {b}')"
            for base, label, phrase in items for i, (a, b) in enumerate(zip(phrase.split(), phrase.split()[1:]))]
    return rf"""
WITH t(tid, label, is_base, n_grams, tpos, tgram) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS key, list_filter(string_split_regex(
        lower(replace(coalesce(text, ''), chr(8490), chr(8491))), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM documents),
g AS (SELECT doc_id, key, unnest(range(1, len(w))) AS i,
             unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d),
h AS (SELECT doc_id, key, tid, label, is_base, n_grams, i - 1 - tpos AS diag, bit_or(CAST(1 AS BIGINT) << tpos) AS mask
      FROM g JOIN t ON gram = tgram GROUP BY ALL),
s AS (SELECT *, CASE WHEN is_base OR coalesce(diag - lag(diag) OVER (PARTITION BY doc_id, key, tid ORDER BY diag), 99)
                          > {license_scan.NEAR} THEN 1 ELSE 0 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, key, tid ORDER BY diag) AS run FROM s),
m AS (SELECT doc_id, key, tid, label, is_base, least(bit_count(bit_or(mask)) / n_grams, 1.0) AS share,
             greatest(min(diag), 0) AS start FROM r GROUP BY doc_id, key, tid, label, is_base, n_grams, run),
f AS (SELECT * FROM m WHERE CASE WHEN is_base THEN share = 1 ELSE share >= {license_scan.MIN_SHARE} END),
a AS (SELECT doc_id, key, count(*) FILTER (WHERE is_base) AS n_base, min(start) FILTER (WHERE is_base) AS first_word,
             max(start) FILTER (WHERE is_base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id, key)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id, key)"""


@query("op5_license_scan", _license_sql())
def op5(spark, sf_dir):
    return license_scan.license_digest(documents(spark, sf_dir))


@query("op6_token_orc")
def op6(spark, sf_dir):
    return token_orc.tokenise(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_language_codes")
def op7(spark, sf_dir):
    return language_ecoc.held_out_languages(documents(spark, sf_dir))


@query("op8_source_mix")
def op8(spark, sf_dir):
    return pivotal_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op9_personal_data")
def op9(spark, sf_dir):
    return pii.personal_data_digest(documents(spark, sf_dir))


@query("op10_piece_round_trip")
def op10(spark, sf_dir):
    return piece_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_tokenizer_alignment")
def op11(spark, sf_dir):
    return cross_tokenizer.align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_divergence_audit", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
w AS (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_sum FROM k GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce(lang_sum, 0) AS lang_sum,
             CAST(coalesce((SELECT sum(n) FROM c JOIN k USING (lang, term) WHERE c.lang = a.lang AND c.source = a.source), 0)
                  AS BIGINT) AS n_sum
      FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (n_sum + v) AS p,
             1 + 1000000000 * (lang_n + 1) // (lang_sum + v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""")
def op12(spark, sf_dir):
    return divergence_audit.audit(documents(spark, sf_dir))


@query("op13_token_counts")
def op13(spark, sf_dir):
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
