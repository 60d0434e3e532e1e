"""Fixtures of the tests in this folder (imported by name)."""
import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "h string, n int, w string, kept string, text_sha256 string, score string, `a.b` string")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank, tied, repeated and very long texts, and columns with clashing names."""
    prose = "The quick brown fox jumps over the lazy dog while seven wizards mix quartz. "
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"),
        (5, "one two", "en", "b"), (6, prose * 12, "en", "b"), (7, prose * 12, "en", "c"),
        (7, prose * 12, "en", "c"), (None, prose * 12, "de", "c"), (None, None, None, None),
        (8, "Same Line here\n" * 40, "fr", "a"), (9, "1234 5678", None, "a"), (10, "Été ▁x <s> \x00 \U0001f600", "fr", "é"),
        (11, "Mail a@b.co, x.@d.e IP 1.2.3.4 or 300.1.1.1; card 4539 1488 0343 6467 call +1 (830) 555-5433.", "en", "b"),
        (12, " ".join(f"w{i % 997}x{i}" for i in range(20000)), "en", "a"),
        (13, "# $ % & | < > " * 30, "es", "z"), (14, "CC BY cc-by General Public License ALL RIGHTS\nreserved", "en", "z"),
        (14, "another text under the id fourteen", "en", "z"),
    ]
    return spark.createDataFrame([(*r, None, "h", 1, "w", "k", "t", "s", "ab") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
