"""Quality rules as weak supervision.

Eight rules vote good (1), bad (-1) or abstain (0) on every document.  A rule
that looks for one kind of junk abstains where it sees none: what it does not
look for is no evidence that a document is good.
Expectation-maximisation over the table of distinct vote patterns (at most
3^8 = 6,561 rows whatever the corpus) estimates, for either class, how often
each rule votes bad; the posterior probability of a good document then
replaces an all-must-pass filter.

One pass over the texts writes the counts and votes (some 100 bytes a
document) to the shared folder; everything after that reads them.  Counting
repeated three-word windows stays inside the row: window hashes are sorted
with their positions, so a very long text costs n log n.

Defined results: null text counts as empty (no words: ``base_failed``);
repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.  EM starts from the rules themselves, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, words, write_and_read

RULES = ["r_prose", "r_letters", "r_symbols", "r_lines", "r_repeats", "r_capitals", "r_variety", "r_marks"]
SYMBOLS = "#*$%&|<>"
#: Pseudo-counts (bad, good votes) that keep the classes apart and rates off 0 and 1,
#: for every PRIOR_DOCS documents: a fixed share, so that they weigh alike in any larger corpus.
PRIOR = {"good": (1.0, 20.0), "bad": (2.0, 2.0)}
PRIOR_DOCS = 200
ITERATIONS = 15


def _repeat_words(w: Column, n: Column) -> dict[str, Column]:
    """Steps that count the words standing in a 3-word window found twice or more."""
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    return {"windows": F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))}


def _twice(s: Column) -> Column:
    """Positions, ascending, of the windows whose hash occurs twice in sorted ``s``."""
    def equal(i: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))

    idx = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
    return F.when(F.size(s) > 1, F.array_sort(F.transform(idx, lambda i: s[i]["i"])))


def _covered(p: Column) -> Column:
    """Words that windows of three at the ascending positions ``p`` cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(p, start, lambda a, x: F.struct(
        x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts the rules look at, one row per input row."""
    def without(c: Column, chars: str) -> Column:
        for ch in chars:
            c = F.replace(c, F.lit(ch), F.lit(""))
        return c

    df = id_and_text(docs, id_col, text_col)
    df = df.withColumn("w", words(F.col("text")))
    df = df.withColumn("n", F.size("w"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(_repeat_words(F.col("w"), F.col("n")))
    df = df.withColumn("windows", F.sort_array("windows"))
    df = df.withColumn("at", _twice(F.col("windows")))
    df = df.withColumn("letters", F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))
    size = F.octet_length("text")
    return df.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (size - F.octet_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("at")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.length("letters").alias("n_alnum"),
        F.length(F.regexp_replace("letters", r"\P{Lu}+", "")).alias("n_capitals"),
        (size - F.octet_length(without(F.col("text"), ".!?"))).alias("n_marks"))


def votes() -> dict[str, Column]:
    """Each rule as a column of 1 (good), -1 (bad) or 0 (abstains)."""
    c, n = F.col, F.col("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, F.lit(-1)).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    never = F.lit(False)
    chars = c("word_chars")
    prose = ((50 * c("n_symbols") <= n) & (10 * c("n_capitals") <= chars) & (4 * c("n_marks") <= n)
             & (50 * c("n_marks") >= n) & (chars >= 3 * n) & (chars <= 12 * n))
    return {
        "r_prose": vote(never, prose),
        "r_letters": vote(100 * c("n_alnum") < 92 * chars, 100 * c("n_alnum") >= 96 * chars),
        "r_symbols": vote(10 * c("n_symbols") > n, never),
        "r_lines": vote(10 * c("n_dup_lines") > 3 * c("n_lines"), never),
        "r_repeats": vote(10 * c("n_repeat_words") > 3 * n, never),
        "r_capitals": vote(10 * c("n_capitals") > 3 * chars, never),
        "r_variety": vote(20 * c("n_distinct") < n, 4 * c("n_distinct") >= n),
        "r_marks": vote((2 * c("n_marks") > n) | ((n >= 200) & (200 * c("n_marks") < n)), never),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def posterior_good(model: dict) -> Column:
    """Probability of the good class given the votes, as one expression."""
    logit = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for rule in RULES:
        g, b = model["good"][rule], model["bad"][rule]  # how often the rule says bad
        logit = logit + (F.when(F.col(rule) == -1, F.lit(math.log(g / b)))
                         .when(F.col(rule) == 1, F.lit(math.log((1 - g) / (1 - b)))).otherwise(0.0))
    return 1.0 / (1.0 + F.exp(-logit))


def fit(patterns: DataFrame, iterations: int = ITERATIONS) -> dict:
    """EM over ``patterns`` (the vote columns and ``n``).

    Each step is one aggregation to a single row.  The first expectation takes
    a document with any bad vote as bad with 0.9.  The pseudo-counts grow with
    the rows above ``PRIOR_DOCS``, so the same mix of votes gives the same model
    at any such size.  Without rows the model is the one of the pseudo-counts.
    """
    any_bad = F.least(*RULES) == -1
    good = F.when(any_bad, 0.1).otherwise(0.95)
    model = None
    for _ in range(iterations):
        p = patterns.withColumn("g", F.col("n") * good).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum(F.when(F.col(r) == v, F.col(k))).alias(f"{r}_{k}_{v}")
                for r in RULES for k in "gb" for v in (-1, 1)]
        row = p.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), *sums).first()
        take = lambda k: float(row[k] or 0.0)
        share = max(1.0, (take("g") + take("b")) / PRIOR_DOCS)
        model = {"prior": min(max((take("g") + share) / (take("g") + take("b") + 2.0 * share), 1e-6), 1 - 1e-6)}
        for name, k in (("good", "g"), ("bad", "b")):
            bad0, good0 = (x * share for x in PRIOR[name])
            model[name] = {r: (take(f"{r}_{k}_-1") + bad0) / (take(f"{r}_{k}_-1") + take(f"{r}_{k}_1") + bad0 + good0)
                           for r in RULES}
        good = posterior_good(model)
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5, iterations: int = ITERATIONS) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``posterior`` and ``kept``."""
    counts = text_counts(docs, id_col, text_col)
    counts = write_and_read(counts.withColumns(votes()), "weak-rules")
    # Documents that fail the base are bad already and would only teach EM that.
    patterns = write_and_read(
        counts.where(~base_failed()).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    model = fit(patterns, iterations)
    return (counts.withColumn("posterior", posterior_good(model)).withColumn("base_failed", base_failed())
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior"))
