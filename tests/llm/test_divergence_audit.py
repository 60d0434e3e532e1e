"""Operator 12 against plain Python integers."""
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import corpus, edge, nothing  # noqa: F401

from chatsieve.llm import divergence_audit as audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(FOLD))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {x for x, _ in counts}:
        own = {s: c for (x, s), c in counts.items() if x == lang}
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = Counter()
        for c in own.values():
            total.update(c)

        def shares(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // n for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return sorted(out)


def rows_of(docs):
    return [tuple(r) for r in docs.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("name", ["edge", "corpus", "nothing"])
def test_audit_equals_plain_integers(name, request):
    docs = request.getfixturevalue(name)
    out = audit.audit(docs)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute(rows_of(docs))


def test_small_blocks_and_batches_change_nothing(corpus, monkeypatch):
    """Many runs of few rows, and terms that go on over batches."""
    monkeypatch.setattr(audit, "BLOCK_ENTRIES", 700)
    monkeypatch.setattr(audit, "RUN_ROWS", 50)
    monkeypatch.setattr(audit, "BLOCK_PAIRS", 3)
    spark = corpus.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, audit.audit(corpus, top=5).collect())) == brute(rows_of(corpus), top=5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_groups_without_terms_ties_and_thresholds(spark):
    text = "alpha Beta 12 gamma-DELTA éa"
    rows = [("en", "a", text)] * 3 + [("en", "b", "alpha alpha beta"), ("en", None, None), ("en", "d", "..."), (None, "x", "solo"),
                                     ("", "x", "solo"), ("de", "z", "rare"), ("de", "y", "rare"), ("en", "e", "ALPHA gamma")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least in (1, 2, 3, 9):
        assert sorted(map(tuple, audit.audit(docs, least).collect())) == brute(rows, least)
    ties = [r for r in brute(rows) if r[:3] == ("en", "a", "term")]
    assert len({r[4] for r in ties}) < len(ties)


def test_shares_stay_exact_beyond_64_bits(spark):
    n = [0, 1, 10 ** 9, 9 * 10 ** 11, 10 ** 15]
    total = [1, 3, 7 * 10 ** 11 + 1, 9 * 10 ** 15 - 1]
    df = spark.createDataFrame([(a, t) for a in n for t in total if a < t], "n long, t long")
    for r in df.select("n", "t", audit.share(F.col("n"), F.col("t")).alias("p")).collect():
        assert r["p"] == 1 + 10 ** 9 * (r["n"] + 1) // r["t"]
    assert audit.whole_value(np.array([1000000001]), np.array([1]))[0] == 10 ** 18


def test_terms_of_an_array():
    texts = ["skipped", " The-Éa1b\x00Z ", "", "...", "the\u00a0b"]
    names, codes, text = audit.terms(pa.array([t.encode() for t in texts], pa.binary()).slice(1))
    assert [(names[c], t) for c, t in zip(codes, text.tolist())] == [
        ("the", 0), ("Éa", 0), ("b", 0), ("z", 0), ("the\u00a0b", 3)]
