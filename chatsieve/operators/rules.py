"""Keyword-rule scoring of model outputs (fixed evaluation items).

Two scorers exist and deliberately differ:

* ``score_outputs`` (per-item detail): matches on the output with all
  whitespace removed, skips empty keywords, gives partial credit
  ``hits / max(1, groups)``; zero groups give 0.0.
* ``rule_pass_rates`` (aggregate): matches on the trimmed raw output, an
  empty keyword always matches, an item passes only when **all** groups hit;
  zero groups pass.

An empty group never hits in either.  Keywords are not whitespace-stripped,
so a keyword containing a space can never match the whitespace-free output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.text import (
    WS_CLASS, contains_any, literal_array, strip_ws, utrim,
)

EMPTY_STR_ARR = "array<string>"
EMPTY_NESTED = "array<array<string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- E1
def extract_output(df: DataFrame, fields=None, out: str = "output",
                   strict: bool = False) -> DataFrame:
    """First string-typed field among ``fields`` that is not null, trimmed.

    Columns missing from the schema or not of string type are skipped.  When
    no candidate column exists this raises; a row with all candidates null
    gets null, or fails the job when ``strict``.
    """
    fields = fields or D.OUTPUT_FIELDS
    types = dict(df.dtypes)
    present = [f for f in fields if types.get(f) == "string"]
    if not present:
        raise KeyError(f"no output field among {fields}; columns are {df.columns}")
    value = F.coalesce(*[utrim(F.col(f"`{f}`")) for f in present])
    if strict:
        value = F.when(value.isNull(), F.raise_error(F.lit("record has no output field"))) \
            .otherwise(value)
    return df.withColumn(out, value)


# ---------------------------------------------------------------- E4 / E5
def must_have_columns(norm: Column, groups: Column) -> dict[str, Column]:
    groups = F.coalesce(groups, F.array().cast(EMPTY_NESTED))
    safe = lambda g: F.coalesce(g, F.array().cast(EMPTY_STR_ARR))
    hit = lambda g: contains_any(norm, safe(g))
    hits = F.size(F.filter(groups, hit))
    total = F.size(groups)
    return {
        "must_hit_count": hits,
        "must_total": total,
        "rule_score": (hits / F.greatest(F.lit(1), total)).cast("double"),
        "missed_groups": F.filter(groups, lambda g: ~hit(g)),
    }


def forbidden_hits(norm: Column, forbidden: Column) -> Column:
    forbidden = F.coalesce(forbidden, F.array().cast(EMPTY_STR_ARR))
    return F.filter(forbidden, lambda t: t.isNotNull() & (t != F.lit("")) & F.contains(norm, t))


# ---------------------------------------------------------------- E6
def extract_category(output, categories=None) -> Column:
    """Category named on the ``场景分类:`` line of an answer.

    The first list member contained in the captured text wins (list order),
    else its first 20 characters, else ''.
    """
    categories = categories or D.CATEGORIES
    # Python's \s is Unicode-aware (and crosses newlines); use the same class.
    pattern = "(?U)" + D.CATEGORY_LINE_REGEX.replace(r"\s", WS_CLASS)
    raw = utrim(F.regexp_extract(_col(output), pattern, 1))
    cats = literal_array(categories)
    first = F.try_element_at(F.filter(cats, lambda c: F.contains(raw, c)), F.lit(1))
    return F.coalesce(first, F.substring(raw, 1, D.CATEGORY_FALLBACK_CHARS), F.lit(""))


# ---------------------------------------------------------------- E8
def score_columns(output: Column, groups: Column, forbidden: Column, gold: Column,
                  use_gold_category: bool, categories=None) -> dict[str, Column]:
    norm = strip_ws(output)
    pred = extract_category(output, categories)
    must = must_have_columns(norm, groups)
    hits = forbidden_hits(norm, forbidden)
    cat_ok = F.lit(None).cast("int") if use_gold_category else \
        F.when(pred.eqNullSafe(gold), 1).otherwise(0)
    return {
        "pred_category": pred,
        "category_correct": cat_ok,
        "must_hit_count": must["must_hit_count"],
        "must_total": must["must_total"],
        "rule_score": must["rule_score"],
        "missed_groups": must["missed_groups"],
        "forbidden_hits": hits,
        "risky": F.when(F.size(hits) > 0, 1).otherwise(0),
    }


def score_outputs(items: DataFrame, outputs: DataFrame, use_gold_category: bool = True,
                  key="id", categories=None, output_col: str = "output") -> DataFrame:
    """Join items to outputs on ``key`` and add the per-item rule scores.

    ``items`` carries ``category, question, must_have_any, forbidden`` and
    optionally ``risk_level``; ``outputs`` carries ``output``.  Both sides
    are keyed (``key`` may list several columns, e.g. ``run`` and ``id``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    item_cols = set(items.columns)
    risk = F.col("risk_level") if "risk_level" in item_cols else F.lit("")
    groups = F.col("must_have_any") if "must_have_any" in item_cols else F.lit(None).cast(EMPTY_NESTED)
    forb = F.col("forbidden") if "forbidden" in item_cols else F.lit(None).cast(EMPTY_STR_ARR)
    out_keys = [k for k in outputs.columns if k in keys or k not in item_cols]
    joined = items.join(outputs.select(*out_keys), on=[k for k in keys if k in outputs.columns], how="inner")
    sc = score_columns(F.col(output_col), groups, forb, F.col("category"),
                       use_gold_category, categories)
    extra = [c for c in outputs.columns if c not in keys and c not in item_cols and c != output_col]
    return joined.select(
        *[F.col(k) for k in keys], *[F.col(c) for c in extra], F.col("category"),
        risk.alias("risk_level"), F.col("question"), F.col(output_col).alias("output"),
        *[v.alias(k) for k, v in sc.items()],
    )


# ---------------------------------------------------------------- E9 / E10
def _summary_aggs(use_gold_category: bool) -> list[Column]:
    aggs = [
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("rule_score").alias("avg_rule_score"),
        F.avg(F.col("risky").cast("double")).alias("risky_response_rate"),
        F.lit(use_gold_category).alias("use_gold_category"),
    ]
    if not use_gold_category:
        aggs.append((F.coalesce(F.sum("category_correct"), F.lit(0))
                     / F.greatest(F.lit(1), F.count("category_correct"))).cast("double")
                    .alias("category_accuracy"))
    return aggs


def eval_summary(scored: DataFrame, use_gold_category: bool = True) -> DataFrame:
    """One-row summary: n, mean rule score, risky rate (+ category accuracy in infer mode).

    An empty input gives null means (the original divides by zero).
    """
    return scored.agg(*_summary_aggs(use_gold_category))


def eval_summary_by(scored: DataFrame, by=("run",), sets=None,
                    use_gold_category: bool = True) -> DataFrame:
    """Summaries for several groupings in one pass (grouping sets).

    ``sets`` is a list of column lists, e.g. ``[["run"], ["run","category"]]``;
    default is just ``by``.  Missing grouping columns are null in a row and
    ``grouping_id`` tells the sets apart.
    """
    by = list(by)
    sets = sets or [by]
    cols = sorted({c for s in sets for c in s}, key=lambda c: by.index(c) if c in by else len(by))
    set_cols = [[F.col(c) for c in s] for s in sets]
    return scored.groupingSets(set_cols, *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("grouping_id"), *_summary_aggs(use_gold_category))


# ---------------------------------------------------------------- E11
def rule_pass_columns(output: Column, groups: Column, forbidden: Column) -> dict[str, Column]:
    groups = F.coalesce(groups, F.array().cast(EMPTY_NESTED))
    forbidden = F.coalesce(forbidden, F.array().cast(EMPTY_STR_ARR))
    group_ok = lambda g: F.coalesce(
        F.exists(F.coalesce(g, F.array().cast(EMPTY_STR_ARR)),
                 lambda k: k.isNotNull() & F.contains(output, k)), F.lit(False))
    must_pass = (F.size(groups) == 0) | F.coalesce(F.forall(groups, group_ok), F.lit(False))
    hit = F.coalesce(F.exists(forbidden, lambda k: k.isNotNull() & F.contains(output, k)), F.lit(False))
    return {"must_pass": must_pass, "forbidden_hit": hit}


def rule_pass_rates(df: DataFrame, output="output", groups="must_have_any", forbidden="forbidden",
                    by=()) -> DataFrame:
    """Share of rows passing all keyword groups / hitting any forbidden term."""
    rc = rule_pass_columns(_col(output), _col(groups), _col(forbidden))
    aggs = [
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(rc["must_pass"].cast("double")).alias("must_have_pass_rate"),
        F.avg(rc["forbidden_hit"].cast("double")).alias("forbidden_hit_rate"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# ---------------------------------------------------------------- E20
def behaviour_hit_rates(df: DataFrame, text="output", behaviours: dict | None = None,
                        banned=(), by=()) -> DataFrame:
    """Share of answers containing each behaviour's terms, and share free of banned terms.

    ``behaviours`` maps a name (e.g. soothing, advice, action) to its terms.
    """
    behaviours = behaviours or {}
    t = _col(text)
    aggs = [F.count(F.lit(1)).alias("num_samples")]
    for name, terms in behaviours.items():
        aggs.append(F.avg(contains_any(t, literal_array(terms)).cast("double")).alias(f"{name}_rate"))
    clean = ~contains_any(t, literal_array(list(banned)))
    aggs.append(F.avg(clean.cast("double")).alias("no_banned_rate"))
    all_ok = clean
    for terms in behaviours.values():
        all_ok = all_ok & contains_any(t, literal_array(terms))
    aggs.append(F.avg(all_ok.cast("double")).alias("all_behaviours_rate"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
