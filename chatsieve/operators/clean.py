"""Cleaning and filtering of dialogue rows (C1-C14, C25).

Scale notes
-----------
* Keep-first deduplication never uses a window over the duplicate key: a
  group of copies may hold a third of all rows.  ``min(order key)`` per
  128-bit key hash is an aggregate with map-side partial aggregation (a hot
  group collapses to one row per map task before the shuffle), confirmed by
  the key itself where a hash is shared, and joined back on the unique row key.
* Hold-out exclusion (C25) is in ``operators/holdout.py``: an index of
  winnowed fingerprints, never a comparison of every row with every item.
* Question/answer pairing joins turn ``t`` to turn ``t + 1`` on the composite
  key ``(conversation, turn)``: no window partitioned by conversation, so a
  huge conversation spreads over all tasks.
* Phrase lists are literal arrays evaluated row-locally, never a join per
  phrase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve.functions import rolling
from chatsieve.operators.holdout import exclude_contained_holdout, exclude_holdout, flag_contained_holdout  # noqa: F401
from chatsieve.operators.ranking import exact_row_number
from chatsieve.functions.text import (
    contains_any, effective_chars, join_segmented, line_repetition_ratio, literal_array,
    normalize_key, strip_ws,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- C1
def union_parts(parts: dict, part_col: str = "part") -> DataFrame:
    """Concatenate named parts, remembering where each row came from."""
    dfs = [df.withColumn(part_col, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ---------------------------------------------------------------- C2 / C8
def _first_ids(df: DataFrame, keys: list, order_col: str) -> DataFrame:
    """``order_col`` of the first row of every key group.

    Groups are found by a 128-bit hash of the key, so the first aggregate
    shuffles (hash, row key) only, with map-side partial aggregation.  A hash
    may collide: the groups of two rows or more are grouped again by the key
    itself.  A row with a null key part is a group of one (nothing to compare
    it with) and does not merge with other null-key rows.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    any_null = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
    # The lengths keep ("ab", "c") and ("a", "bc") apart.
    parts = [p for k in keys for p in (F.length(k.cast("string")).cast("string"), k.cast("string"))]
    keyed = df.select(F.col(order_col).alias("__o"), *[k.alias(n) for k, n in zip(keys, names)],
                      any_null.alias("__solo"), F.md5(F.concat_ws("|", *parts)).alias("__h"))
    solo = keyed.where("__solo").select("__o")
    keyed = keyed.where("not __solo")
    groups = keyed.groupBy("__h").agg(F.min("__o").alias("__o"), F.count(F.lit(1)).alias("__n"))
    shared = keyed.join(groups.where("__n > 1").select("__h"), "__h", "left_semi")
    firsts = shared.groupBy("__h", *names).agg(F.min("__o").alias("__o"))
    return (groups.where("__n = 1").select("__o").unionByName(firsts.select("__o")).unionByName(solo)
            .withColumnRenamed("__o", order_col))


def first_of_duplicates(df: DataFrame, key, order_col: str) -> DataFrame:
    """Rows of ``df`` whose ``order_col`` is the smallest within their ``key`` group.

    ``key`` is a Column (or list of Columns) computed from the row; rows
    with a null key are all kept (nothing to compare).  ``order_col`` must be
    unique (it is the row key).  The groups come from hashes (``_first_ids``)
    and the rows meet the chosen row keys in one semi-join.
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    return df.join(_first_ids(df, keys, order_col), on=order_col, how="left_semi")


def mark_first_of_duplicates(df: DataFrame, key, order_col: str, out: str = "is_first") -> DataFrame:
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    firsts = _first_ids(df, keys, order_col).withColumn(out, F.lit(True))
    return (df.join(firsts, on=order_col, how="left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))))


def drop_exact_duplicates(df: DataFrame, order_col: str, cols=None) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each group of equal rows."""
    cols = cols or [c for c in df.columns if c != order_col]
    return first_of_duplicates(df, [F.col(c) for c in cols], order_col)


def drop_duplicate_qa(df: DataFrame, order_col: str, question="question", answer="answer") -> DataFrame:
    """Keep the first of each (normalised question, normalised answer) pair."""
    return first_of_duplicates(df, [normalize_key(_col(question)), normalize_key(_col(answer))], order_col)


# ---------------------------------------------------------------- C3
def keep_label(df: DataFrame, value: int = 1, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == F.lit(value))


# ---------------------------------------------------------------- C4
def with_dense_turns(turns: DataFrame, conv="conv_id", turn="turn") -> DataFrame:
    """``turn`` renumbered 0, 1, 2, ... in its order within each conversation.

    Range partitioning plus offsets, so a conversation that holds a third of
    all rows is not one task.
    """
    numbered = exact_row_number(turns, [conv], [turn], "__rn")
    return numbered.withColumn(turn, F.col("__rn") - 1).select(*turns.columns)


def extract_qa_pairs(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text",
                     user_role: str = "user", agent_role: str = "assistant") -> DataFrame:
    """Adjacent user -> agent turn pairs from role-labelled turns.

    ``turn`` must be a dense position within the conversation (0, 1, 2, ...);
    ``with_dense_turns`` makes it one where there are gaps.
    Output: conversation, ``turn`` of the question, ``question``, ``answer``.
    """
    q = turns.where(F.col(role) == user_role).select(
        F.col(conv), F.col(turn), F.col(text).alias("question"))
    a = turns.where(F.col(role) == agent_role).select(
        F.col(conv), (F.col(turn) - 1).alias(turn), F.col(text).alias("answer"))
    return q.join(a, on=[conv, turn], how="inner")


def extract_qa_pairs_from_array(df: DataFrame, turns="turns", out_pair: str = "pair_no") -> DataFrame:
    """Pairs (turns[2k], turns[2k+1]) from an alternating turn array (raw labelled lines)."""
    arr = _col(turns)
    n_pairs = F.floor(F.size(arr) / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n_pairs - 1),
        lambda k: F.struct(k.alias(out_pair),
                           F.element_at(arr, k * 2 + 1).alias("question"),
                           F.element_at(arr, k * 2 + 2).alias("answer")))
    pairs = F.when(n_pairs > 0, pairs)
    return df.withColumn("__p", F.explode(pairs)).select("*", "__p.*").drop("__p")


# ---------------------------------------------------------------- C5
def detokenize(c, script: str = "Han") -> Column:
    return join_segmented(c, script)


# ---------------------------------------------------------------- C6
def context_text(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text",
                 target_role: str = "assistant", max_turns: int | None = None,
                 sep: str = "\n", prefix_role: bool = True) -> DataFrame:
    """Prior turns of each ``target_role`` turn as ``role: text`` lines
    (without ``prefix_role`` as the texts alone).

    ``turn`` must be a dense position (``with_dense_turns`` makes it one).
    Each target turn generates the positions it needs (all earlier turns, or
    the last ``max_turns``) and fetches them with an equi-join on
    ``(conversation, turn)``; the lines are gathered by a group on
    ``(conversation, target turn)``, whose size is the context length, so no
    task ever holds a whole conversation.
    """
    targets = turns.where(F.col(role) == target_role).select(F.col(conv), F.col(turn).alias("target_turn"))
    start = F.lit(0) if max_turns is None else F.greatest(F.lit(0), F.col("target_turn") - max_turns)
    wanted = targets.where(F.col("target_turn") > 0).select(
        conv, "target_turn",
        F.explode(F.sequence(start, F.col("target_turn") - 1)).alias(turn))
    line = F.concat_ws(": ", F.col(role), F.col(text)) if prefix_role else F.col(text)
    lines = turns.select(conv, turn, line.alias("__line"))
    ctx = (wanted.join(lines, on=[conv, turn], how="inner")
           .groupBy(conv, "target_turn")
           .agg(F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("__line")))).alias("__l")))
    return ctx.select(conv, F.col("target_turn").alias(turn),
                      F.array_join(F.transform("__l", lambda s: s["__line"]), sep).alias("context"),
                      F.size("__l").alias("context_turns"))


# ---------------------------------------------------------------- C7
def min_effective_chars(df: DataFrame, c="answer", n: int = 20) -> DataFrame:
    return df.where(effective_chars(_col(c)) >= n)


# ---------------------------------------------------------------- C9
# Text that is empty after whitespace removal, has no letter at all, or is a
# bare product / order code (letters and digits with at least one digit and
# nothing else).
MEANINGLESS_REGEX = r"^(|[^\p{L}]*|[A-Za-z0-9_#\-./]*[0-9][A-Za-z0-9_#\-./]*)$"


def is_meaningless(c, pattern: str = MEANINGLESS_REGEX) -> Column:
    return F.coalesce(strip_ws(_col(c)).rlike(pattern), F.lit(True))


def drop_meaningless_question(df: DataFrame, c="question", pattern: str = MEANINGLESS_REGEX) -> DataFrame:
    return df.where(~is_meaningless(c, pattern))


# ---------------------------------------------------------------- C10
def drop_by_phrase(df: DataFrame, c, phrases) -> DataFrame:
    return df.where(~contains_any(_col(c), literal_array(list(phrases))))


# ---------------------------------------------------------------- C11
def with_repetition(df: DataFrame, c="answer", n: int = 20, out: str = "repetition") -> DataFrame:
    """``df`` with the share of repeated character n-grams of the whitespace-free text (0 when null or shorter).

    Rolling hashes in Arrow batches (``functions/rolling.py``): the one step of the
    cleaning operators that runs in Python workers, as no built-in expression carries a
    value from character to character.  The other columns pass through unchanged.
    """
    text = df.withColumn("__text", strip_ws(_col(c)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return text.mapInArrow(lambda batches: rolling.repetition_column(batches, n, out), schema)


def drop_repetitive(df: DataFrame, c="answer", n: int = 20, max_ratio: float = 0.5,
                    by_lines: bool = False) -> DataFrame:
    """Drop repeated-generation texts: share of repeated character n-grams
    (or of repeated lines) above ``max_ratio``."""
    if by_lines:
        return df.where(line_repetition_ratio(_col(c)) <= max_ratio)
    return with_repetition(df, c, n, "__repetition").where(F.col("__repetition") <= max_ratio).drop("__repetition")


# ---------------------------------------------------------------- C12
def drop_flagged(df: DataFrame, flags: DataFrame, on) -> DataFrame:
    """Remove rows judged elsewhere (a flag table keyed like ``df``)."""
    return df.join(flags, on=on, how="left_anti")


# ---------------------------------------------------------------- C13
def cleaning_funnel(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reason",
                    kept_label: str = "kept") -> DataFrame:
    """Attach the first matching drop reason (or ``kept``) to every row.

    ``rules`` is an ordered list of ``(reason, condition)``; a null condition
    counts as not matching.  Every row gets exactly one reason, so the counts
    of ``funnel_counts`` always add up to the input size.
    """
    expr = F.lit(kept_label)
    for name, cond in reversed(rules):
        expr = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(expr)
    return df.withColumn(reason, expr)


def funnel_counts(tagged: DataFrame, reason: str = "reason", order: list[str] | None = None) -> DataFrame:
    counts = tagged.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    if order:
        pos = F.array_position(literal_array(order), F.col(reason))
        counts = counts.withColumn("step", pos.cast("int"))
    return counts


# ---------------------------------------------------------------- C14
def sample_weight(df: DataFrame, c, phrases, low: float = 0.5, out: str = "weight") -> DataFrame:
    """Down-weight instead of delete: ``low`` when a phrase is present, else 1.0."""
    hit = contains_any(_col(c), literal_array(list(phrases)))
    return df.withColumn(out, F.when(hit, F.lit(low)).otherwise(F.lit(1.0)))
