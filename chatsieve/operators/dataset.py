"""Dataset building: augmentation, classification, variants, split, quotas,
chat-format rows (C15-C24, P6).

Scale notes
-----------
* Sampling and splitting order rows by ``md5(seed|key)``; the order is the
  same in every engine and on every re-run, so lost tasks recompute the
  same rows.
* Exact per-stratum ranks use ``ranking.exact_row_number`` (range
  partitioning + per-partition offsets) instead of a window partitioned by
  stratum, which would put a whole stratum (there are only a handful) in
  one task.
* Quotas are computed on the per-stratum count table, whose size is the
  number of strata, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.text import contains_any, literal_array
from chatsieve.operators.selection import first_rows
from chatsieve.operators.ranking import exact_row_number, null_safe_join


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- C15
def augment(base: DataFrame, templates: DataFrame, slots: DataFrame, on,
            source: str = "rule_augmented", source_col: str = "source",
            base_source: str = "raw_cleaned", columns=("question", "answer")) -> DataFrame:
    """Add rule-written rows: each template row is filled with the slot rows
    sharing its key ``on`` (equi-join), tagged with ``source``.

    Templates carry ``question_template`` / ``answer_template`` with a
    ``{slot}`` placeholder; slots carry a ``slot`` column.
    """
    filled = templates.join(slots, on=on, how="inner").select(
        F.replace(F.col("question_template"), F.lit("{slot}"), F.col("slot")).alias(columns[0]),
        F.replace(F.col("answer_template"), F.lit("{slot}"), F.col("slot")).alias(columns[1]),
        F.lit(source).alias(source_col),
    )
    b = base.select(*[F.col(c) for c in columns],
                    (F.col(source_col) if source_col in base.columns else F.lit(base_source)).alias(source_col))
    return b.unionByName(filled)


# ---------------------------------------------------------------- C16
def classify(text, rules, default: str = "其他咨询场景") -> Column:
    """First rule (in list order) with a keyword contained in ``text``."""
    expr = F.lit(default)
    for name, kws in reversed(list(rules)):
        expr = F.when(contains_any(_col(text), literal_array(list(kws))), F.lit(name)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- C17 / C18
def quality_top_k(df: DataFrame, score, k: int, tie_key: str) -> DataFrame:
    """The ``k`` best rows by ``score`` (NaN best, null worst; ties broken by the
    unique ``tie_key``), in no order: selected by the k-th score, so that no task
    holds k rows (``operators/selection.py``)."""
    score = _col(score).cast("double")
    return first_rows(df, tie_key, F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(-score), [tie_key], k)


def variants(df: DataFrame, eff: Column, score: Column, tie_key: str, specs: list[dict]) -> DataFrame:
    """Several dataset variants from one scored pass.

    ``specs``: ``[{"name": "strict20_all", "min_chars": 20},
    {"name": "strict20_top", "min_chars": 20, "top_k": 5800}, ...]``.
    Returns ``(tie_key, variant)`` rows (a row can be in several variants);
    join back on ``tie_key`` for the full rows.

    The texts are read once: effective length and score go into a narrow
    ``(key, eff, score)`` table written with ``checkpoint()``, and every
    variant (a filter, or a filter plus a global top-k) reads that copy.
    """
    from chatsieve.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    narrow = df.select(F.col(tie_key), eff.alias("__eff"), score.alias("__score")).checkpoint(eager=True)
    out = None
    for spec in specs:
        v = narrow.where(F.col("__eff") >= spec["min_chars"])
        if spec.get("top_k"):
            v = quality_top_k(v, "__score", spec["top_k"], tie_key)
        v = v.select(F.col(tie_key), F.lit(spec["name"]).alias("variant"))
        out = v if out is None else out.unionByName(v)
    return out


# ---------------------------------------------------------------- C19
def hash_key(seed, *cols) -> Column:
    """``md5(seed|c1|c2...)`` hex string, identical in Spark and DuckDB."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def hash_number(hashed: Column) -> Column:
    """The first 52 bits of a hex hash as a number, in the hash's order."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long")


def split_train_eval(df: DataFrame, key: str, eval_fraction: float = 0.1, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Deterministic split: a row is 'eval' when its hash falls below the fraction.

    The first 52 bits of ``md5(seed|key)`` are compared as a number with the
    fraction, so any fraction from 0 to 1 works, no shuffle or global rank is
    needed and the split is stable when rows are added.
    """
    threshold = int(round(eval_fraction * (1 << 52)))
    h = hash_number(hash_key(seed, key))
    return df.withColumn(out, F.when(h < F.lit(threshold), F.lit("eval")).otherwise(F.lit("train")))


def split_train_eval_exact(df: DataFrame, key: str, eval_fraction: float = 0.1, seed: int = 42,
                           stratum: str | None = None, out: str = "split") -> DataFrame:
    """Exact split: in each stratum (or overall) the first
    ``round(fraction x size)`` rows in ``md5(seed|key)`` order are 'eval'.

    Ranks come from ``exact_row_number`` (range-partitioned), sizes from a
    partially aggregated count, so a large stratum is never one task.
    """
    parts = [stratum] if stratum else []
    hashed = df.withColumn("__h", hash_key(seed, key))
    ranked = exact_row_number(hashed, parts, ["__h", key], "__rn")
    if stratum:
        sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
        ranked = null_safe_join(ranked, sizes, [stratum])
    else:
        # A scalar subquery: the size travels with the plan instead of a job at build time.
        ranked = ranked.withColumn("__size", df.agg(F.count(F.lit(1))).scalar())
    n_eval = F.round(F.col("__size") * F.lit(eval_fraction)).cast("long")
    return ranked.withColumn(out, F.when(F.col("__rn") <= n_eval, F.lit("eval")).otherwise(F.lit("train"))) \
        .drop("__h", "__rn", "__size")


# ---------------------------------------------------------------- C20
def category_distribution(df: DataFrame, category="category") -> DataFrame:
    """Count and share per category.  The share divides by the total over the
    already-aggregated table (one row per category), so the un-partitioned
    window runs on a handful of rows."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total)


# ---------------------------------------------------------------- C21
def stratum_quotas(counts: DataFrame, n: int, stratum: str = "stratum", count: str = "n",
                   floors: dict | None = None) -> DataFrame:
    """Exact quotas summing to ``min(n, total)``.

    Floors are granted first (capped by the stratum size); the rest is shared
    in proportion to the remaining capacity by largest remainder (ties by
    stratum name).  Runs on the count table (one row per stratum).
    """
    floors = floors or {}
    fl = F.lit(0)
    for k, v in floors.items():
        fl = F.when(F.col(stratum) == F.lit(k), F.lit(int(v))).otherwise(fl)
    w_all = Window.partitionBy()
    t = counts.select(F.col(stratum), F.col(count).cast("long").alias("c")) \
        .withColumn("reserved", F.least(F.col("c"), fl.cast("long")))
    t = t.withColumn("cap", F.col("c") - F.col("reserved")) \
        .withColumn("rest", F.greatest(F.least(F.lit(n), F.sum("c").over(w_all)) - F.sum("reserved").over(w_all),
                                       F.lit(0)))
    cap_total = F.sum("cap").over(w_all)
    ideal = F.when(cap_total > 0, F.col("rest") * F.col("cap") / cap_total).otherwise(F.lit(0.0))
    t = t.withColumn("ideal", ideal).withColumn("base", F.floor("ideal").cast("long"))
    t = t.withColumn("left", F.col("rest") - F.sum("base").over(w_all))
    rank = F.row_number().over(Window.partitionBy().orderBy(
        (F.col("ideal") - F.col("base")).desc(), F.col(stratum)))
    t = t.withColumn("extra", F.when(rank <= F.col("left"), 1).otherwise(0))
    return t.select(F.col(stratum), (F.col("reserved") + F.col("base") + F.col("extra")).alias("quota"))


def quota_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42,
                 floors: dict | None = None) -> DataFrame:
    """Stratified sample without replacement of exactly ``min(n, rows)`` rows.

    Within a stratum (a null one is a stratum) rows are taken in ``md5(seed|key)``
    order up to its quota; ``key`` is unique.  They are selected by the value of
    the last one taken, so no task holds a stratum's quota.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    quotas = stratum_quotas(counts.withColumnRenamed(stratum, "__s"), n, "__s", "n", floors) \
        .withColumnRenamed("__s", stratum)
    return first_rows(df, key, hash_number(hash_key(seed, key)), [hash_key(seed, key), key], quotas, stratum)


# ---------------------------------------------------------------- C22 / C23
def build_messages(df: DataFrame, question="question", answer="answer", category="category",
                   system_prompt: str = D.SYSTEM_PROMPT, source: str = "raw_cleaned") -> DataFrame:
    """System + user (category, question) + assistant chat rows."""
    user = F.concat(F.lit(D.CATEGORY_LABEL), _col(category), F.lit("\n" + D.USER_QUESTION_LABEL),
                    _col(question))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), _col(answer).alias("content")),
    )
    src = F.col("source") if "source" in df.columns else F.lit(source)
    return df.select("*", msgs.alias("messages")).withColumn("source", src)


def build_context_messages(df: DataFrame, context="context", answer="answer", category="category",
                           system_prompt: str = D.SERVICE_SYSTEM_PROMPT) -> DataFrame:
    """System + user (task, scene, dialogue context) + assistant chat rows.

    ``context`` is the dialogue so far, one labelled line per turn
    (``context_lines`` of the speaker and text columns, or ``clean.context_text``).
    """
    user = F.concat(F.lit(D.CONTEXT_TASK + "\n\n" + D.CONTEXT_SCENE_LABEL), _col(category),
                    F.lit("\n" + D.CONTEXT_LABEL + "\n"), _col(context))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), _col(answer).alias("content")),
    )
    return df.select("*", msgs.alias("messages"))


def speaker_line(role, text, names: dict | None = None) -> Column:
    """One context line, ``<speaker>：<text>``; an unknown role stands for itself."""
    name = _col(role)
    for k, v in (names or D.SPEAKER_NAMES).items():
        name = F.when(_col(role) == k, F.lit(v)).otherwise(name)
    return F.concat(name, F.lit("："), _col(text))


def build_instruction_rows(df: DataFrame, question="question", answer="answer",
                           instruction: str | None = None) -> DataFrame:
    """Instruction / input / output rows (alpaca layout)."""
    if instruction is None:
        return df.select(_col(question).alias("instruction"), F.lit("").alias("input"),
                         _col(answer).alias("output"))
    return df.select(F.lit(instruction).alias("instruction"), _col(question).alias("input"),
                     _col(answer).alias("output"))


# ---------------------------------------------------------------- C24
def profile(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Per column: type, non-null count and row count (one aggregate pass);
    with ``order_col`` also the first row's value, as text."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    if order_col:
        texts = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
        aggs.append(F.min_by(texts, F.col(order_col)).alias("__first"))
    for c in df.columns:
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"__nn_{c}"))
    row = df.agg(*aggs)
    stack = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"),
                 F.col(f"`__nn_{c}`").alias("non_null"), F.col("__rows").alias("n_rows"),
                 F.lit(i).alias("position"), *([F.col(f"__first.c{i}").alias("first_value")] if order_col else []))
        for i, (c, t) in enumerate(df.dtypes)]))
    return row.select(stack)


# ---------------------------------------------------------------- P6
def sample_rows(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """All rows when ``n`` is None / <= 0; else the first ``n`` rows in
    ``md5(seed|key)`` order (a seeded shuffle prefix), in no order; ``key`` is unique."""
    if n is None or n <= 0:
        return df
    return first_rows(df, key, hash_number(hash_key(seed, key)), [hash_key(seed, key), key], n)
