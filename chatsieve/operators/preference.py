"""Preference pairs: prompt resolution and formatting, validation, expansion,
defect tags, checks and statistics (D1-D12).

All per-row work is column expressions; the only shuffles are the duplicate
triplet count and the statistics aggregates (both partially aggregated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.chat import render_prompt
from chatsieve.functions.text import contains_any, effective_chars, literal_array, utrim
from chatsieve.operators.rules import extract_category


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


# ---------------------------------------------------------------- D11
def compose_answer(category, reply) -> Column:
    """The two-line answer format: category line, then reply line."""
    return F.concat(F.lit(D.CATEGORY_LABEL), _col(category), F.lit("\n" + D.REPLY_LABEL), _col(reply))


# ---------------------------------------------------------------- D3
def normalize_user_prompt(raw, categories=None) -> Column:
    """Trim; add the category-choice preamble unless the text already holds
    the user-question label."""
    categories = categories or D.CATEGORIES
    r = utrim(_col(raw))
    preamble = D.CHOOSE_CATEGORY_PREAMBLE + D.CATEGORY_JOINER.join(categories) + "\n" + D.USER_QUESTION_LABEL
    return F.when(F.contains(r, F.lit(D.USER_QUESTION_LABEL)), r).otherwise(F.concat(F.lit(preamble), r))


def given_category_prompt(category, question) -> Column:
    return F.concat(F.lit(D.CATEGORY_LABEL), _col(category), F.lit("\n" + D.USER_QUESTION_LABEL), _col(question))


# ---------------------------------------------------------------- D2
def is_formatted(prompt, markers=(D.IM_START, D.ALT_HEADER_MARKER)) -> Column:
    p = _col(prompt)
    cond = F.lit(False)
    for m in markers:
        cond = cond | F.contains(p, F.lit(m))
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------- D1
def resolve_prompt(df: DataFrame, categories=None, system_prompt: str = D.SYSTEM_PROMPT,
                   out: str = "prompt") -> Column:
    """The training prompt of a pair.

    The first *truthy* (non-null, non-empty) of ``prompt``, ``user_prompt``,
    ``question`` is used; a whitespace-only value is truthy and yields the
    preamble with an empty question.  A ``prompt`` already in chat format
    passes through (trimmed); anything else is normalised and rendered.
    Rows with none of the three give null (see ``validate_pairs``).
    """
    cols = set(df.columns)
    get = lambda c: F.col(c).cast("string") if c in cols else F.lit(None).cast("string")
    p, up, q = get("prompt"), get("user_prompt"), get("question")
    rendered = lambda x: render_prompt(normalize_user_prompt(x, categories), system_prompt)
    return (F.when(_truthy(p), F.when(is_formatted(utrim(p)), utrim(p)).otherwise(rendered(p)))
            .when(_truthy(up), rendered(up))
            .when(_truthy(q), rendered(q)))


# ---------------------------------------------------------------- D4 / D5
def pair_problem(df: DataFrame) -> Column:
    """Why a pair is unusable, or null: empty chosen / rejected, no prompt,
    whitespace-only prompt source."""
    cols = set(df.columns)
    get = lambda c: F.col(c).cast("string") if c in cols else F.lit(None).cast("string")
    chosen = utrim(get("chosen"))
    rejected = utrim(get("rejected"))
    p, up, q = get("prompt"), get("user_prompt"), get("question")
    src = F.when(_truthy(p), p).when(_truthy(up), up).when(_truthy(q), q)
    return (F.when(F.coalesce(chosen, F.lit("")) == "", F.lit("empty_chosen"))
            .when(F.coalesce(rejected, F.lit("")) == "", F.lit("empty_rejected"))
            .when(src.isNull(), F.lit("no_prompt"))
            .when(utrim(src) == "", F.lit("blank_prompt")))


def format_pairs(df: DataFrame, categories=None, system_prompt: str = D.SYSTEM_PROMPT,
                 strict: bool = False, keep=()) -> tuple[DataFrame, DataFrame]:
    """(valid pairs as prompt/chosen/rejected, quarantined rows with a reason).

    ``strict`` fails the job on the first unusable pair instead, like the
    original loader.  A blank prompt is kept (it is valid there) but also
    reported in the quarantine output.
    """
    problem = pair_problem(df)
    tagged = df.withColumn("__problem", problem)
    if strict:
        tagged = tagged.withColumn("__problem", F.when(
            F.col("__problem").isin("empty_chosen", "empty_rejected", "no_prompt"),
            F.raise_error(F.concat(F.lit("invalid preference pair: "), F.col("__problem"))))
            .otherwise(F.col("__problem")))
    valid = tagged.where(F.col("__problem").isNull() | (F.col("__problem") == "blank_prompt")).select(
        *[F.col(k) for k in keep],
        resolve_prompt(df, categories, system_prompt).alias("prompt"),
        utrim(F.col("chosen").cast("string")).alias("chosen"),
        utrim(F.col("rejected").cast("string")).alias("rejected"))
    quarantine = tagged.where(F.col("__problem").isNotNull()) \
        .withColumnRenamed("__problem", "problem")
    return valid, quarantine


# ---------------------------------------------------------------- D7
def expand_pairs(src: DataFrame, variants: list[dict], keep=()) -> DataFrame:
    """One row per (source row, variant), generated in-row (no join).

    Each variant is ``{"prompt_type": str, "user_prompt": Column,
    "rejected": Column, "rejected_source": str}``; the columns are
    expressions over the source row.  Rows whose rejected expression is null
    are dropped (e.g. a model-output variant without an output).
    """
    structs = [F.struct(
        F.lit(v["prompt_type"]).alias("prompt_type"),
        F.lit(i).alias("variant_no"),
        v["user_prompt"].cast("string").alias("user_prompt"),
        v["rejected"].cast("string").alias("rejected"),
        F.lit(v.get("rejected_source", "rule")).alias("rejected_source"),
    ) for i, v in enumerate(variants)]
    ex = src.select(*[F.col(k) for k in keep], F.col("chosen"), F.explode(F.array(*structs)).alias("__v"))
    return ex.select(*keep, "chosen", "__v.*").where(F.col("rejected").isNotNull())


# ---------------------------------------------------------------- D8
def rejected_defects(rejected, category, min_chars: int = 20, action_terms=(), banned_terms=(),
                     question=None, categories=None, topic_min_len: int = 4) -> Column:
    """Defect tags of a rejected answer: too_short, no_action, banned_promise,
    misclassified, off_topic."""
    r = _col(rejected)
    tags = [
        F.when(effective_chars(r) < min_chars, F.lit("too_short")),
        F.when(~contains_any(r, literal_array(list(action_terms))), F.lit("no_action")) if action_terms else None,
        F.when(contains_any(r, literal_array(list(banned_terms))), F.lit("banned_promise")) if banned_terms else None,
        F.when(extract_category(r, categories) != _col(category), F.lit("misclassified")),
    ]
    if question is not None:
        words = F.filter(F.split(F.lower(_col(question)), r"[^\p{L}]+"),
                         lambda w: F.char_length(w) >= topic_min_len)
        tags.append(F.when((F.size(words) > 0) & ~contains_any(F.lower(r), words), F.lit("off_topic")))
    return F.array_compact(F.array(*[t for t in tags if t is not None]))


# ---------------------------------------------------------------- D9
def must_include_groups(spec=None) -> list[list[str]]:
    """'a/b' and 'a或b' mean a or b."""
    import re
    spec = spec or D.CHOSEN_MUST_INCLUDE
    return [[t for t in re.split("[/或]", s) if t] for s in spec]


def chosen_violations(chosen, groups) -> Column:
    """Groups of required elements missing from the chosen answer."""
    c = _col(chosen)
    return F.filter(F.array(*[literal_array(g) for g in groups]).cast("array<array<string>>"),
                    lambda g: ~contains_any(c, g))


def check_pairs(df: DataFrame, groups, chosen="chosen", triplet=("prompt", "chosen", "rejected")) -> DataFrame:
    """Validation counts: pairs whose chosen answer misses a required group,
    and duplicate (prompt, chosen, rejected) rows beyond the first.

    Duplicates are counted without shuffling the texts of unique rows:

    1. rows are grouped by a 128-bit hash of the triplet (only hashes move);
       a hash group of one row is certainly a unique triplet;
    2. only rows in hash groups of two or more (true duplicates, or a
       collision) are regrouped by their full text, so the count is exact.
    """
    cols = [F.col(c) for c in triplet]
    flag = F.when(F.size(chosen_violations(chosen, groups)) > 0, 1).otherwise(0)
    # length-prefixed fields: distinct triplets cannot serialise alike
    framed = F.concat_ws("\u0001", *[F.concat(F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"),
                                              F.coalesce(c, F.lit(""))) for c in cols])
    keyed = df.select(*cols, flag.alias("__v"), F.xxhash64(framed).alias("__h1"),
                      F.substring(F.md5(framed), 1, 16).alias("__h2"))
    per_hash = keyed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__v"))
    shared = per_hash.where(F.col("__n") > 1).select("__h1", "__h2")
    distinct_shared = keyed.join(shared, on=["__h1", "__h2"], how="left_semi").select(*triplet).distinct()
    zero = F.lit(0).cast("long")
    parts = per_hash.select(F.col("__n").cast("long").alias("n"), F.col("__v").cast("long").alias("v"),
                            F.when(F.col("__n") == 1, 1).otherwise(0).cast("long").alias("u"), zero.alias("d")) \
        .unionByName(distinct_shared.select(zero.alias("n"), zero.alias("v"), zero.alias("u"),
                                            F.lit(1).cast("long").alias("d")))
    t = parts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "v", "u", "d")])
    return t.select(F.col("n").alias("num_pairs"), F.col("v").alias("violations"),
                    (F.col("n") - F.col("u") - F.col("d")).alias("duplicate_triplets"))


# ---------------------------------------------------------------- D9b
def targeted_claims(answer, category, claims: dict) -> Column:
    """Banned claims of the answer's scene that the answer makes.

    ``claims`` maps a scene to its banned terms; evaluated in-row from a
    literal map (no join per term)."""
    if not claims:
        return F.array().cast("array<string>")
    m = F.create_map(*[x for k, v in claims.items() for x in (F.lit(k), literal_array(v))])
    terms = F.coalesce(F.try_element_at(m, _col(category)), F.array().cast("array<string>"))
    return F.filter(terms, lambda t: (t != F.lit("")) & F.contains(_col(answer), t))


# ---------------------------------------------------------------- D10
def pair_stats(df: DataFrame, dims=("category", "prompt_type", "risk_level")) -> DataFrame:
    """Long table (dimension, value, n) for each dimension, plus the total
    (dimension 'num_pairs'), from one grouping-sets aggregate."""
    dims = list(dims)
    sets = [[F.col(d)] for d in dims] + [[]]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("n"))
    nd = len(dims)
    dim_expr = F.lit("num_pairs")
    val_expr = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << nd) - 1 - (1 << (nd - 1 - i))
        dim_expr = F.when(F.col("__gid") == gid, F.lit(d)).otherwise(dim_expr)
        val_expr = F.when(F.col("__gid") == gid, F.col(d).cast("string")).otherwise(val_expr)
    return g.select(dim_expr.alias("dimension"), val_expr.alias("value"), F.col("n"))


def pair_stats_maps(long: DataFrame) -> DataFrame:
    """The statistics-file layout: total plus one map per dimension."""
    per = long.where(F.col("dimension") != "num_pairs").groupBy("dimension").agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("value"), F.lit("null")), "n")))
        .alias("counts"))
    return per


# ---------------------------------------------------------------- D12
def assign_risk_level(category, text, high_categories=(), high_terms=(), medium_categories=(),
                      medium_terms=()) -> Column:
    """high / medium / low by scene and phrase hits (first matching rule wins)."""
    t = _col(text)
    cat = _col(category)
    in_cats = lambda cats: cat.isin(*cats) if cats else F.lit(False)
    return (F.when(in_cats(high_categories) | contains_any(t, literal_array(list(high_terms))), F.lit("high"))
            .when(in_cats(medium_categories) | contains_any(t, literal_array(list(medium_terms))), F.lit("medium"))
            .otherwise(F.lit("low")))
