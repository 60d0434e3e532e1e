"""Corpus and pairwise metrics (E12-E19, E21, E22).

Scale notes
-----------
* Character BLEU: rows are hash-partitioned and sorted by row id once; both
  sides' n-grams are then counted and clipped row by row in Arrow batches of
  a bounded number of characters, which give one row of sums a key, so
  n-grams are neither exploded nor shuffled (but for keys repeated over more
  text than a portion) and no corpus or frequent n-gram becomes a hot key.
* BERTScore: token norms are computed once, token pairs come from a join on
  the sample id only (tokens² per sample, never across samples), and the
  best match per candidate and per reference token comes from one
  grouping-sets aggregate.
* Win rate, token accuracy, rubric roll-ups: conditional sums (partial
  aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve import defaults as D
from chatsieve.functions import clipped
from chatsieve.functions.text import chars, strip_ws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- E12 / E22
def positional_align(left: DataFrame, right: DataFrame, pos: str = "pos", strict: bool = True) -> DataFrame:
    """Pair the i-th row of ``left`` with the i-th row of ``right``.

    ``strict``: unequal sizes fail the job (checked lazily inside the plan:
    a full outer join raises on a position present on one side only).
    Otherwise the shorter side decides (Python ``zip``).
    """
    if not strict:
        return left.join(right, on=pos, how="inner")
    lk = left.withColumn("__l", F.lit(True))
    rk = right.withColumn("__r", F.lit(True))
    j = lk.join(rk, on=pos, how="full_outer")
    guard = F.when(F.col("__l").isNull() | F.col("__r").isNull(),
                   F.raise_error(F.lit("positional inputs differ in size"))).otherwise(F.lit(True))
    return j.where(guard).drop("__l", "__r")


def pair_answers(runs: DataFrame, pos: str = "id", run: str = "run", answer: str = "answer",
                 run_names: list[str] | None = None) -> DataFrame:
    """One row per position with one answer column per run (``<run>_answer``);
    positions missing in any run are dropped (``zip`` truncates).  An answer
    that is present but null counts as present.  ``pos`` may be several columns."""
    keys = [pos] if isinstance(pos, str) else list(pos)
    p = runs.groupBy(*keys).pivot(run, run_names).agg(F.first(answer).alias("a"), F.count(F.lit(1)).alias("n"))
    names = [c[:-2] for c in p.columns if c not in keys and c.endswith("_n")]
    for c in names:
        p = p.where(F.col(f"`{c}_n`") > 0)
    return p.select(*keys, *[F.col(f"`{c}_a`").alias(f"{c}_answer") for c in names])


# ---------------------------------------------------------------- E13
def char_tokens(text) -> Column:
    return chars(strip_ws(_col(text)))


# ---------------------------------------------------------------- E14
def bleu_counts(df: DataFrame, hyp: str, ref: str, row_id, by=(), max_n: int = 4) -> DataFrame:
    """Per corpus: clipped matches and denominators per order n, hypothesis
    and reference length, row count.  ``row_id`` is the unique key: one column
    or a list of them.

    Rows of equal key count as one, with the n-grams of all its texts.  Clipped
    matches are counted key by key in Arrow batches (``functions/clipped.py``),
    in portions of a bounded number of characters, so the memory of a task does
    not follow the number of its n-grams.
    """
    by = list(by)
    keys = [row_id] if isinstance(row_id, (str, Column)) else list(row_id)
    ids = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*by, *[_col(k).alias(i) for k, i in zip(keys, ids)],
                     strip_ws(F.coalesce(_col(hyp), F.lit(""))).alias("__h"),
                     strip_ws(F.coalesce(_col(ref), F.lit(""))).alias("__r"))
    # The window brings rows of one key together, one after the other, and
    # marks where a key begins; a key is one row as a rule.
    key = Window.partitionBy(*by, *ids)
    rows = base.select(*by, *ids, (F.row_number().over(key.orderBy(F.lit(0))) == 1).alias("__new"), "__h", "__r")
    nums = [f"num{n}" for n in range(1, max_n + 1)]
    dens = [f"den{n}" for n in range(1, max_n + 1)]
    extra = ["hyp_len", "ref_len", "num_rows"]
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in base.drop("__h", "__r").schema],
        T.StructField("__n", T.IntegerType()), T.StructField("__g", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ["__ch", "__cr"] + nums + dens + extra]])
    names, n_by = schema.names, len(by)
    sums = rows.mapInArrow(lambda batches: clipped.clipped_matches(batches, n_by, max_n, names), schema)
    # One row a corpus and task, and the n-grams of keys too long for one portion.
    parts = sums.groupBy(*by, *ids, "__n", "__g").agg(*[F.sum(c).alias(c) for c in ["__ch", "__cr"] + nums + dens + extra])
    clip = F.least("__ch", "__cr")
    parts = parts.select(*by, *extra, *dens, *[F.when(F.col("__n") == n, clip).otherwise(F.col(c)).alias(c)
                                               for n, c in enumerate(nums, 1)])
    aggs = [F.sum(c).cast("long").alias(c) for c in extra + dens + nums]
    return parts.groupBy(*by).agg(*aggs) if by else parts.agg(*aggs)


def bleu_from_counts(counts: DataFrame, max_n: int = 4, k: float = 5.0) -> Column:
    """Corpus BLEU with equal weights, brevity penalty and method-4 smoothing.

    A zero numerator at order n (when the hypothesis length h > 1) becomes
    ``1 / (2^z k / ln h)``, divided by ``den_n``, z counting the zero
    numerators so far: the current public rule.  Zero unigram matches give 0.
    """
    h = F.col("hyp_len")
    r = F.col("ref_len")
    bp = F.when(h > r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - r / h))
    log_sum = F.lit(0.0)
    zeros = F.lit(0)
    fail = F.lit(False)
    log_h = F.log(h.cast("double"))
    for n in range(1, max_n + 1):
        num = F.col(f"num{n}")
        den = F.col(f"den{n}")
        zeros = zeros + F.when(num == 0, 1).otherwise(0)
        smoothed = log_h / (F.pow(F.lit(2.0), zeros.cast("double")) * k) / den
        p = F.when(num > 0, num / den).when(h > 1, smoothed)
        fail = fail | p.isNull() | (p <= 0)
        log_sum = log_sum + F.lit(1.0 / max_n) * F.log(F.when(p > 0, p))
    return F.when(F.col("num1") == 0, F.lit(0.0)).when(fail, F.lit(0.0)).otherwise(bp * F.exp(log_sum))


def corpus_char_bleu(df: DataFrame, hyp: str, ref: str, row_id, by=(), max_n: int = 4) -> DataFrame:
    counts = bleu_counts(df, hyp, ref, row_id, by, max_n)
    return counts.withColumn("bleu", bleu_from_counts(counts, max_n))


# ---------------------------------------------------------------- E15
def _norm(v: Column) -> Column:
    sq = F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def bertscore(tokens: DataFrame, sid: str = "sid", side: str = "side", tok: str = "tok", vec: str = "vec",
              weight: str | None = "weight", cand: str = "cand", ref: str = "ref") -> DataFrame:
    """Per-sample greedy-matching precision, recall and F1 from token vectors.

    ``tokens`` has one row per (sample, side, token) with its contextual
    vector; the vectors come from an encoder outside Spark.  No IDF, no
    baseline rescaling; ``weight`` (default 1) lets special tokens count 0.
    A zero vector has similarity 0 to everything; a sample with tokens on one
    side only, or of weight 0 only, scores 0 in all three.
    """
    w = F.col(weight) if weight and weight in tokens.columns else F.lit(1.0)
    # Norms are per-token scalars computed once before the join; the cosine is
    # dot / (|a| |b|), so no per-element division is repeated inside a lambda.
    t = tokens.select(F.col(sid).alias("sid"), F.col(side).alias("side"), F.col(tok).alias("tok"),
                      F.col(vec).alias("v"), _norm(F.col(vec)).alias("nv"), w.cast("double").alias("w"))
    c = t.where(F.col("side") == cand).select("sid", F.col("tok").alias("ct"), F.col("v").alias("cv"),
                                              F.col("nv").alias("cn"), F.col("w").alias("cw"))
    r = t.where(F.col("side") == ref).select("sid", F.col("tok").alias("rt"), F.col("v").alias("rv"),
                                             F.col("nv").alias("rn"), F.col("w").alias("rw"))
    dot = _dot(F.col("cv").cast("array<double>"), F.col("rv").cast("array<double>"))
    cos = F.coalesce(F.try_divide(dot, F.col("cn") * F.col("rn")), F.lit(0.0))
    sims = c.join(r, on="sid", how="inner").select("sid", "ct", "rt", "cw", "rw", cos.alias("cos"))
    # Best match per candidate token and per reference token from one
    # grouping-sets aggregate over the similarity rows (one pass, not two).
    best = sims.groupingSets([[F.col("sid"), F.col("ct")], [F.col("sid"), F.col("rt")]],
                             F.col("sid"), F.col("ct"), F.col("rt")).agg(
        F.grouping_id().alias("__gid"), F.max("cos").alias("m"),
        F.first("cw").alias("cw"), F.first("rw").alias("rw"))
    cand_side = F.col("__gid") == 1   # (sid, ct): rt aggregated away
    ref_side = F.col("__gid") == 2    # (sid, rt): ct aggregated away
    out = best.groupBy("sid").agg(
        F.try_divide(F.sum(F.when(cand_side, F.col("m") * F.col("cw"))), F.sum(F.when(cand_side, F.col("cw"))))
        .alias("precision"),
        F.try_divide(F.sum(F.when(ref_side, F.col("m") * F.col("rw"))), F.sum(F.when(ref_side, F.col("rw"))))
        .alias("recall"))
    # Samples without a pair of tokens have no similarity row; they score 0.
    out = t.select("sid").distinct().join(out, "sid", "left").fillna(0.0, subset=["precision", "recall"])
    f1 = F.when((F.col("precision") + F.col("recall")) != 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def bertscore_means(scores: DataFrame, by=()) -> DataFrame:
    aggs = [F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
            F.avg("f1").alias("f1_mean"), F.count(F.lit(1)).alias("num_samples")]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


# ---------------------------------------------------------------- E16 / E17
def win_rate_aggs(a: str, b: str) -> list[Column]:
    """Aggregate expressions win / tie / lose / total of ``b`` over ``a``.

    Only rows where both scores are present are pairs.  A NaN on either side
    counts in the total but in none of the three (as NumPy comparisons do);
    Spark alone would call NaN the largest value and equal to itself.
    """
    ca, cb = F.col(a), F.col(b)
    paired = ca.isNotNull() & cb.isNotNull()
    ok = paired & ~(F.isnan(ca) | F.isnan(cb))
    count_if = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return [count_if(ok & (cb > ca)).alias("win"), count_if(ok & (cb == ca)).alias("tie"),
            count_if(ok & (cb < ca)).alias("lose"), count_if(paired).alias("total")]


def win_rates(df: DataFrame) -> DataFrame:
    """Add win / tie / lose rates to the output of ``win_rate_aggs``."""
    return df.select("*", *[(F.col(x) / F.col("total")).alias(f"{x}_rate") for x in ("win", "tie", "lose")])


def win_rate(df: DataFrame, a: str, b: str, by=(), with_means: bool = False) -> DataFrame:
    """Win / tie / lose of ``b`` over ``a`` per paired row (strict ``>``).

    Feed one row per item with both runs' scores side by side (e.g. a
    ``pivot`` on the run); ``with_means`` adds each side's mean over its
    present values in the same pass.
    """
    aggs = win_rate_aggs(a, b)
    if with_means:
        aggs += [F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return win_rates(g)


def improvement(before, after) -> dict[str, Column]:
    diff = _col(after) - _col(before)
    return {"abs_improvement": diff, "rel_improvement_pct": diff / _col(before) * 100}


# ---------------------------------------------------------------- E18
def comparison_table(metrics: DataFrame, run: str = "run", baseline_run: str | None = None,
                     bert_f1: str = "f1_mean", must_pass: str = "must_have_pass_rate",
                     forbidden: str = "forbidden_hit_rate", win: str = "win_rate",
                     labels=None) -> DataFrame:
    """Long (metric, run, value) table: F1, must-have pass, 1 - forbidden hit,
    win rate (the baseline run's win rate is fixed at 0.5).  ``labels`` names
    the four metrics where the columns hold something else."""
    labels = list(labels or D.COMPARISON_LABELS)
    win_col = F.col(win) if baseline_run is None else \
        F.when(F.col(run) == baseline_run, F.lit(D.BASELINE_WIN_RATE)).otherwise(F.col(win))
    wide = metrics.select(F.col(run).alias("run"),
                          F.col(bert_f1).cast("double").alias(labels[0]),
                          F.col(must_pass).cast("double").alias(labels[1]),
                          (1 - F.col(forbidden)).cast("double").alias(labels[2]),
                          win_col.cast("double").alias(labels[3]))
    return wide.unpivot("run", labels, "metric", "value")


# ---------------------------------------------------------------- E19
def token_accuracy_counts(preds, labels, ignore: int = D.IGNORE_INDEX) -> tuple[Column, Column]:
    """(correct, total) of one row: predictions[:-1] vs labels[1:], ignoring ``ignore``."""
    p, lab = _col(preds), _col(labels)
    n = F.greatest(F.least(F.size(p), F.size(lab)) - 1, F.lit(0))
    ps = F.slice(p, 1, n)
    ls = F.slice(lab, 2, n)
    pairs = F.zip_with(ps, ls, lambda x, y: F.struct(x.alias("p"), y.alias("l")))
    total = F.size(F.filter(pairs, lambda s: s["l"] != F.lit(ignore)))
    correct = F.size(F.filter(pairs, lambda s: (s["l"] != F.lit(ignore)) & (s["p"] == s["l"])))
    return correct, total


def masked_token_accuracy(df: DataFrame, preds: str, labels: str, by=()) -> DataFrame:
    """Micro-averaged accuracy over unmasked next-token positions; 0.0 when none."""
    correct, total = token_accuracy_counts(preds, labels)
    aggs = [F.sum(correct).cast("long").alias("correct"), F.sum(total).cast("long").alias("total")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("mean_token_accuracy",
                        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


def positional_token_accuracy(preds: DataFrame, labels: DataFrame, row: str, pos: str = "pos", pred: str = "pred",
                              label: str = "label", by=(), ignore: int = D.IGNORE_INDEX) -> DataFrame:
    """``masked_token_accuracy`` with a row per position: the prediction at a place is of the label at the next one.

    Joined on (row, place), so a long sequence is no long array; a label without
    a prediction before it (the first one, or one whose scores are missing) does
    not count.  ``by`` are columns of ``labels``.
    """
    ahead = preds.select(row, (F.col(pos) + 1).alias(pos), pred)
    hits = labels.where(F.col(label) != ignore).join(ahead, [row, pos])
    aggs = [F.count_if(F.col(pred) == F.col(label)).alias("correct"), F.count(F.lit(1)).alias("total")]
    g = hits.groupBy(*by).agg(*aggs) if by else hits.agg(*aggs)
    return g.withColumn("mean_token_accuracy",
                        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- E21
def rubric_rollup(df: DataFrame, dims: list[str], by=()) -> DataFrame:
    """Mean score per judged dimension (long layout)."""
    ids = list(by) or []
    cast = df.select(*ids, *[F.col(d).cast("double").alias(d) for d in dims])
    if not ids:
        cast = cast.withColumn("__all", F.lit(1))
        ids = ["__all"]
    long = cast.unpivot(ids, dims, "dimension", "score")
    out = long.groupBy(*ids, "dimension").agg(F.avg("score").alias("mean_score"),
                                              F.count("score").alias("n"))
    return out.drop("__all") if "__all" in ids else out

