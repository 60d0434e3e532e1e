"""Shared pieces of the registered queries: table loading, the registry and
the word lists used on the test tables (whose text is English, German,
French and Spanish pseudo-prose, so the queries pass their own vocabularies).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    """Register a query under ``name`` together with its DuckDB oracle SQL."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flat_groups(c: Column) -> Column:
    """array<array<string>> -> 'a|b;c' (for oracle comparison)."""
    return F.array_join(F.transform(c, lambda g: F.array_join(g, "|")), ";")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# Test-table vocabularies ----------------------------------------------------
# Scene rules for the test tables: (category, keywords) in rule order.
TEST_SCENES = [
    ("english", [" the ", " and "]),
    ("german", [" und ", " die "]),
    ("french", [" le ", " la "]),
    ("spanish", [" el ", " los "]),
]
TEST_CATEGORIES = [name for name, _ in TEST_SCENES] + ["other"]
TEST_FORBIDDEN = ["", "einach", "tionsh", "ouai", "ntre"]
# Words of at least this many letters in a question become keyword groups.
TEST_KEYWORD_MIN_LEN = 7


def sql_scene_case(text_sql: str) -> str:
    """DuckDB CASE equivalent of ``classify`` with TEST_SCENES."""
    parts = []
    for name, kws in TEST_SCENES:
        cond = " OR ".join(f"contains({text_sql}, '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


# DuckDB spelling of the Python whitespace class.
SQL_WS = r"[\s\x{0b}\x{85}\p{Z}\x{1c}-\x{1f}]"
