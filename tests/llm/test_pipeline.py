"""Every stage of the corpus pipeline against plain Python, and all of them over the smallest tables."""
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from llm_fixtures import edge, nothing  # noqa: F401
from test_models import components_brute, key

from chatsieve.llm import language_ecoc

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The output of each stage over sf0.001, in order."""
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_and_read(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        out.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    return out


def test_registered():
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert [f"op{n}_" in " ".join(E.queries()) for n in range(1, 11)] == [True] * 10


def test_language_stage_keeps_texts_with_letters(stages):
    assert Counter(stages[1]) == Counter(r for r in stages[0] if r["text"] and any(c.isalpha() for c in r["text"]))


def test_language_stage_rejects_by_the_classifier(spark):
    rnd = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_ecoc.train_on_fold(docs)
    clean = docs.where(F.col("text").rlike(r"\p{L}"))
    kept = language_ecoc.with_known_language(clean, model).groupBy("lang").count().collect()
    assert len(kept) == 4 and key(kept) == key(clean.groupBy("lang").count().collect())
    junk = spark.createDataFrame([(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), None)
                                  for i in range(40)], docs.schema)
    good = {r["doc_id"] for r in language_ecoc.predict(junk, model).collect() if not r["ambiguous"] and r["score"] >= 0.95}
    assert {r["doc_id"] for r in language_ecoc.with_known_language(junk, model).collect()} == good
    assert len(good) < 20


def test_dedup_stage_keeps_the_smallest_id(stages):
    first = {}
    for r in sorted(stages[1], key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r)
    assert Counter(stages[2]) == Counter(first.values())


def test_near_stage_keeps_one_of_a_component(stages):
    found = components_brute([(r["doc_id"], r["text"]) for r in stages[2]], 5, 4, 5)
    stay = {c for _, _, c in found}
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(stay)


def test_mix_stage_repeats_documents(stages):
    had, got = Counter(stages[3]), Counter(stages[4])
    assert set(got) <= set(had) and all(1 <= n <= 2 for n in got.values())
    n = lambda c: sum(k * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r, k in c.items())
    assert abs(n(got) - 1.5 * n(had)) < 0.05 * n(had)


def test_last_stage_has_every_row(stages):
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    assert all(r["n_tokens"] > 0 for r in stages[5])


@pytest.mark.parametrize("fixture", ["edge", "nothing"])
def test_stages_take_nulls_and_repeats(spark, request, fixture):
    docs = request.getfixturevalue(fixture)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_and_read(stage(spark, docs, "/root/testdata/sf0.001"), "test-edge")
        docs.count()
    assert "n_tokens" in docs.columns
