"""Text column expressions.

All functions return ``pyspark.sql.Column`` objects built from built-in
expressions, so they stay inside whole-stage code generation.

Python's ``str.strip()`` and ``re`` ``\\s`` are Unicode aware and also treat
U+001C..U+001F as whitespace; Spark's ``trim`` removes only U+0020.  Java's
``(?U)\\s`` covers the Unicode White_Space property, so adding ``\\x1c-\\x1f``
gives exactly Python's set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsieve.functions.rolling import ngram_repetition

# The whitespace class used by every strip / whitespace-removal
# below (Python str.isspace() set, expressed for Java regex).
WS_CLASS = r"[\s\x1c-\x1f]"
WS_RUN = r"(?U)" + WS_CLASS + "+"
EDGE_WS = r"(?U)^" + WS_CLASS + "+|" + WS_CLASS + r"+\z"
# Letters and digits count as "effective" characters.
NON_EFFECTIVE = r"[^\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Unicode-aware ``str.strip()``."""
    return F.regexp_replace(_c(c), EDGE_WS, "")


def strip_ws(c) -> Column:
    """Remove every Unicode whitespace character (``re.sub(r"\\s+", "", x)``)."""
    return F.regexp_replace(_c(c), WS_RUN, "")


def effective_chars(c) -> Column:
    """Number of letters and digits in the text."""
    return F.char_length(F.regexp_replace(_c(c), NON_EFFECTIVE, ""))


def normalize_key(c) -> Column:
    """Normalised text used as a dedup / hold-out key: whitespace removed, lower case."""
    return F.lower(strip_ws(c))


def contains_any(text, terms, empty_term_matches: bool = False) -> Column:
    """True when ``text`` contains at least one of ``terms``.

    ``empty_term_matches=False`` skips empty and null terms (``any(t and t in x)``);
    ``True`` follows plain ``any(t in x)`` where an empty term always matches.
    A null terms array counts as empty.  The result is never null.
    """
    text = _c(text)
    terms = F.coalesce(_c(terms), F.array().cast("array<string>"))
    if empty_term_matches:
        pred = lambda t: t.isNotNull() & F.contains(text, t)
    else:
        pred = lambda t: t.isNotNull() & (t != F.lit("")) & F.contains(text, t)
    return F.coalesce(F.exists(terms, pred), F.lit(False))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else \
        F.array().cast("array<string>")


def literal_nested_array(groups) -> Column:
    return F.array(*[literal_array(g) for g in groups]).cast("array<array<string>>") if groups else \
        F.array().cast("array<array<string>>")


def chars(c) -> Column:
    """Code-point characters of a string; empty (not ``['']``) for an empty
    string; null for null."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None).cast("array<string>"))
            .when(F.char_length(c) > 0, F.split(c, ""))
            .otherwise(F.array().cast("array<string>")))


def char_ngrams(text, n: int) -> Column:
    """All character (code point) n-grams of a string, in order.

    One regex pass: a zero-width lookahead captures the ``n`` code points
    starting at every position, so the cost is O(length x n).  (Building
    n-grams with ``substring(s, i, n)`` per position walks UTF-8 from the
    start each time and is quadratic; zipping shifted arrays nests the same
    array expression twice per level, which Spark does not share inside
    higher-order functions.)  Positions inside a surrogate pair are skipped
    so characters outside the BMP count once.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        return chars(text)
    pattern = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(1))


def repetition_ratio(c, n: int = 20) -> Column:
    """Share of repeated character n-grams of the whitespace-free text:
    ``1 - distinct / total`` (0 when the text is null or shorter than n).

    Rolling hashes in Arrow batches, 8 bytes a character; equal hashes are
    confirmed by the characters at their places (``functions/rolling.py``).
    """
    return ngram_repetition(strip_ws(c), n)


def line_repetition_ratio(c) -> Column:
    """Share of repeated lines: ``1 - distinct lines / lines``."""
    lines = F.split(_c(c), "\n")
    total = F.size(lines)
    return F.when(total > 0, F.lit(1.0) - F.size(F.array_distinct(lines)) / total).otherwise(F.lit(0.0))


def join_segmented(c, script: str = "Han") -> Column:
    """Drop the spaces that word segmentation put between two characters of ``script``.

    Two passes of a non-overlapping replace close every gap in a run.
    """
    pat = r"(\p{Is%s})[ \t]+(\p{Is%s})" % (script, script)
    once = F.regexp_replace(_c(c), pat, "$1$2")
    return F.regexp_replace(once, pat, "$1$2")


def split_list(c, sep: str = ",") -> Column:
    """Split on ``sep``, trim, drop empties (``[x.strip() for x in s.split(',') if x.strip()]``)."""
    parts = F.transform(F.split(_c(c), sep), lambda x: utrim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def lstrip_newlines(c) -> Column:
    return F.regexp_replace(_c(c), r"^\n+", "")


def rstrip_newlines(c) -> Column:
    return F.regexp_replace(_c(c), r"\n+\z", "")


def strip_newlines(c) -> Column:
    return F.regexp_replace(_c(c), r"^\n+|\n+\z", "")
