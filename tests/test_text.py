"""Text expressions against plain-Python statements of the same rules."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, needs
from chatsieve.functions import text as T

EDGE = ["", "   ", None, "　a b　", "x\u0085y\u001cz", "a\tb\nc", "emoji 😀 ok 😀",
        "full：width", "  lead and trail \n", " nbsp "]


def _rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def test_strip_ws_and_utrim_match_python(spark):
    df = _rows(spark, EDGE)
    out = df.select("i", T.strip_ws("s").alias("a"), T.utrim("s").alias("b")).orderBy("i").collect()
    for r, v in zip(out, EDGE):
        if v is None:
            assert r.a is None and r.b is None
        else:
            assert r.a == re.sub(r"\s+", "", v)
            assert r.b == v.strip()


def test_effective_chars(spark):
    vals = ["ab12 ,.!", "é😀ü", "", "中文，标点。"]
    out = _rows(spark, vals).select("i", T.effective_chars("s").alias("n")).orderBy("i").collect()
    assert [r.n for r in out] == [4, 2, 0, 4]


def test_contains_any_empty_and_null_terms(spark):
    df = spark.createDataFrame([("abc", ["", None, "zz"]), ("abc", None), ("abc", ["b"]), ("abc", [])],
                               "s string, t array<string>")
    out = df.select(T.contains_any("s", "t").alias("x"),
                    T.contains_any("s", "t", empty_term_matches=True).alias("y")).collect()
    assert [r.x for r in out] == [False, False, True, False]
    assert [r.y for r in out] == [True, False, True, False]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 20])
def test_char_ngrams_match_python(spark, n):
    vals = ["abcdefghij" * 3, "ab😀cdé😀😀x", "", "abc", "😀" * 25]
    out = _rows(spark, vals).select("i", T.char_ngrams(F.col("s"), n).alias("g")).orderBy("i").collect()
    for r, v in zip(out, vals):
        assert r.g == [v[i:i + n] for i in range(len(v) - n + 1)]


def _repetition_py(text, n):
    s = re.sub(r"\s+", "", text)
    grams = [s[i:i + n] for i in range(len(s) - n + 1)]
    return 0.0 if not grams else 1 - len(set(grams)) / len(grams)


@needs(SF_SMALL)
def test_repetition_ratio_brute_force_on_documents(spark):
    """The registered ``repetition`` query has no SQL oracle; check it here."""
    import __spark_entry__ as E
    got = {r.doc_id: r.repetition for r in E.queries()["repetition"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id] == pytest.approx(round(_repetition_py(d.text, 20), 6), abs=1e-6)


def test_line_repetition(spark):
    vals = ["a\nb\na\na", "one", ""]
    out = _rows(spark, vals).select("i", T.line_repetition_ratio("s").alias("r")).orderBy("i").collect()
    assert [round(r.r, 6) for r in out] == [0.5, 0.0, 0.0]


def test_join_segmented_han(spark):
    vals = ["我 想 退 货 可以 吗", "a b 中 文", "中 a 文"]
    out = _rows(spark, vals).select("i", T.join_segmented("s").alias("j")).orderBy("i").collect()
    assert [r.j for r in out] == ["我想退货可以吗", "a b 中文", "中 a 文"]


def test_split_list(spark):
    out = _rows(spark, [" q_proj, k_proj ,,v_proj ", "", None]) \
        .select("i", T.split_list("s").alias("p")).orderBy("i").collect()
    assert out[0].p == ["q_proj", "k_proj", "v_proj"]
    assert out[1].p == []


def test_whitespace_helpers_property(spark):
    """Hypothesis-generated strings over a whitespace-heavy alphabet: Unicode
    strip / removal / effective characters agree with Python."""
    from hypothesis import given, settings, strategies as st
    alphabet = st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     "
                                    " 　ab中文😀1,.​"))

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=40, max_size=40))
    def check(values):
        df = _rows(spark, values)
        got = df.select("i", T.utrim("s").alias("a"), T.strip_ws("s").alias("b"),
                        T.effective_chars("s").alias("c")).orderBy("i").collect()
        for r, v in zip(got, values):
            assert r.a == v.strip()
            assert r.b == re.sub(r"\s+", "", v)
            assert r.c == sum(1 for ch in v if ch.isalnum() and not ch.isspace()
                              and (ch.isalpha() or ch.isdigit()))

    check()
