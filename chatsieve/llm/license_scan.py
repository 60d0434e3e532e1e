"""License scan by diagonal voting.

Templates (short, ASCII, lower case) and documents are cut into rolling word
pairs.  Every pair of every document is joined with the template positions
that hold it; a hit votes for the diagonal ``document position - template
position``.  Votes are aggregated by diagonal, diagonals at most two apart
are merged (an inserted or dropped word moves the rest of the notice by one),
and a merged span is verified by the share of the template's pairs in it.

The join key is the 64-bit hash of the pair and the pair itself is compared
too, so a hit is a hit of the words.  The template table is a parameter of at
most ``MAX_GRAMS`` rows and is broadcast; the documents are never shuffled,
only hits and one narrow marker row per document are.

Defined results: null text counts as empty; rows equal in id and text get the
same result, each its own row; null ids are kept apart by their text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text

# Words: ASCII letters and digits, and everything that is not ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases, each with its label; every place counts.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Templates of the method; a span with at least MIN_SHARE of the word pairs counts.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MIN_SHARE = 0.7
MAX_GRAMS = 20_000
NEAR = 2


def template_grams(spark: SparkSession, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(tid, label, is_base, full, tgram, bit): one row per template position."""
    rows = []
    for is_base, items in ((True, base), (False, templates)):
        for label, phrase in items:
            ws = phrase.split()
            if not phrase.isascii() or phrase != phrase.lower() or not 2 <= len(ws) <= 63:
                raise ValueError(f"a template is 2 to 63 lower-case ASCII words: {phrase!r}")
            tid = f"{'base' if is_base else 'own'}:{label}:{phrase}"
            rows += [(tid, label, is_base, len(ws) - 1, i, f"{a} {b}") for i, (a, b) in enumerate(zip(ws, ws[1:]))]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template positions; the broadcast bound is {MAX_GRAMS}")
    t = spark.createDataFrame(rows, "tid string, label string, is_base boolean, n_grams int, tpos int, tgram string")
    return t.withColumn("th", F.xxhash64("tgram"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE,
         min_share: float = MIN_SHARE) -> DataFrame:
    """Verified spans, and one marker (null ``tid``, ``copies`` = rows) per document.

    Columns: doc_id, key, n_words, tid, label, is_base, start, share, copies.
    """
    spark = docs.sparkSession
    df = id_and_text(docs, id_col, text_col)
    # Templates are ASCII, so only the Kelvin sign could become one of their
    # letters under a lower-casing of all of Unicode; it is kept from that.
    low = F.lower(F.replace("text", F.lit("K"), F.lit("Å")))
    df = df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"),
                   F.array_remove(F.split(low, SEPARATORS, -1), "").alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(
        F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
        lambda a, b: F.concat(a, F.lit(" "), b)))
    pairs = F.coalesce(pairs, F.array().cast("array<string>"))
    # Position 0 is the marker of the document; it has no pair and meets no template.
    df = df.select("doc_id", "key", F.size("w").cast("long").alias("n_words"),
                   F.concat(F.array(F.lit(None).cast("string")), pairs).alias("grams"))
    df = df.select("doc_id", "key", "n_words", F.posexplode("grams").alias("pos", "gram"))
    t = template_grams(spark, templates, base)
    hits = df.join(F.broadcast(t), (F.xxhash64("gram") == F.col("th")) & (F.col("gram") == F.col("tgram")), "left") \
        .where((F.col("pos") == 0) | F.col("tid").isNotNull())
    diag = (F.col("pos") - 1 - F.col("tpos")).cast("long")
    doc = ["doc_id", "key", "n_words"]
    voted = (hits.withColumn("diag", diag)
             .withColumn("bit", F.expr("shiftleft(1L, tpos)"))
             .groupBy(*doc, "tid", "label", "is_base", "n_grams", "diag")
             .agg(F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("copies")))
    # Base phrases must be whole on one diagonal, so theirs are never merged.
    apart = Window.partitionBy(*doc, "tid").orderBy("diag")
    step = F.col("diag") - F.lag("diag").over(apart)
    voted = voted.withColumn("new", F.when(F.col("is_base") | F.col("tid").isNull() | step.isNull() | (step > NEAR), 1)
                             .otherwise(0))
    merged = (voted.withColumn("run", F.sum("new").over(apart.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*doc, "tid", "label", "is_base", "n_grams", "run")
              .agg(F.bit_or("mask").alias("mask"), F.min("diag").alias("start"), F.max("copies").alias("copies")))
    share = F.bit_count("mask") / F.col("n_grams")
    spans = merged.withColumn("share", F.when(share.isNotNull(), F.least(share.cast("double"), F.lit(1.0))))
    enough = F.when(F.col("is_base"), F.col("share") == 1.0).otherwise(F.col("share") >= min_share)
    return spans.where(F.col("tid").isNull() | enough).select(
        *doc, "tid", "label", "is_base", F.greatest("start", F.lit(0)).alias("start"), "share", "copies")


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per input row: counts and places of the base phrases, labels and a score."""
    spans = scan(docs, id_col, text_col, **kw)
    base = F.col("is_base")

    def listed(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")  # as many values as there are labels

    out = spans.groupBy("doc_id", "key", "n_words").agg(
        F.sum(F.when(F.col("tid").isNull(), F.col("copies"))).alias("copies"),
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
