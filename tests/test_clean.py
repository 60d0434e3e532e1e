"""Cleaning operators against brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from chatsieve.functions import rolling
from chatsieve.operators import clean as C


def test_contained_holdout_all_paths_match_brute_force(spark):
    rnd = random.Random(5)
    alphabet = "abcdefgh 退货😀"
    docs = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    items = []
    for i in range(30):
        d = docs[rnd.randrange(len(docs))]
        if i % 3 == 0 or len(d) < 20:
            items.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 15))))
        else:
            a = rnd.randrange(0, len(d) - 15)
            items.append(d[a:a + rnd.randint(5, 40)])
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    idf = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    brute = {(di, ii) for di, d in enumerate(docs) for ii, it in enumerate(items) if it and it in d}
    # default sampling, a modulus so sparse that most items draw no anchor, and k=1
    for k, m in ((12, 8), (6, 10_000), (1, 1)):
        got = {(r.doc_id, r.item_id) for r in
               C.flag_contained_holdout(ddf, idf, "doc_id", "text", "item_id", "text", k=k, modulus=m).collect()}
        assert got == brute, (k, m)


def test_first_of_duplicates_keeps_smallest_key(spark):
    rows = [(5, "A b"), (2, "a b"), (9, "ab"), (1, None), (3, None), (7, "c")]
    df = spark.createDataFrame(rows, "id int, t string")
    kept = sorted(r.id for r in C.first_of_duplicates(df, F.col("t"), "id").collect())
    assert kept == [1, 2, 3, 5, 7, 9]
    kept_norm = sorted(r.id for r in C.drop_duplicate_qa(
        df.withColumn("a", F.lit("x")), "id", "t", "a").collect())
    assert kept_norm == [1, 2, 3, 7]


def test_context_text_and_max_turns(spark):
    turns = [(1, 0, "user", "u0"), (1, 1, "assistant", "a1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a3")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    full = {r.turn: r.context for r in C.context_text(df).collect()}
    assert full == {1: "user: u0", 3: "user: u0\nassistant: a1\nuser: u2"}
    last = {r.turn: r.context for r in C.context_text(df, max_turns=1).collect()}
    assert last == {1: "user: u0", 3: "user: u2"}


def test_extract_pairs_from_array(spark):
    df = spark.createDataFrame([(1, ["q1", "a1", "q2", "a2", "q3"]), (2, ["x"]), (3, [])],
                               "line long, turns array<string>")
    out = sorted((r.line, r.pair_no, r.question, r.answer) for r in C.extract_qa_pairs_from_array(df).collect())
    assert out == [(1, 0, "q1", "a1"), (1, 1, "q2", "a2")]


def test_rolling_hashes_stay_exact_in_portions_and_collisions(monkeypatch):
    rnd = random.Random(8)
    texts = [None, "", "ab", *("".join(rnd.choice("ab\U0001f600é") for _ in range(rnd.randrange(60))) for _ in range(80))]

    def brute(t, n):
        grams = [t[i:i + n] for i in range(len(t or "") - n + 1)]
        return 1.0 - len(set(grams)) / len(grams) if grams else 0.0

    for n in (1, 3, 20):
        want = [brute(t, n) for t in texts]
        assert rolling.repeated_share(texts, n) == want
        with monkeypatch.context() as m:
            m.setattr(rolling, "PORTION", 7)
            m.setattr(rolling, "COMPARED", 5)
            assert rolling.repeated_share(texts, n) == want
            m.setattr(rolling.Codes, "grams", lambda self, n: self.codes[:max(0, len(self.codes) - n + 1)].astype(np.uint64) % 2)
            assert rolling.repeated_share(texts, n) == want  # hashes that say nearly nothing


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rnd = np.random.default_rng(2)
    for size in (5, 16, 17, 400):
        hashes = rnd.integers(0, 50, size).astype(np.uint64)
        for window in (1, 2, 3, 16):
            at = set(rolling.winnowed(hashes, window).tolist())
            want = {i for s in range(size - window + 1) for i in range(s, s + window) if hashes[i] == hashes[s:s + window].min()}
            assert at == want


def test_contained_holdout_edges(spark):
    """Items of all length classes, nulls, repeated rows and items, a hot passage, ids of other types."""
    hot = "the very same passage of more than twenty-seven characters"
    docs = [("a", hot + " and more"), ("b", "x" + hot), ("b", "x" + hot), (None, hot), ("c", None), ("d", ""), ("e", hot[:20]),
            *((f"h{i}", f"{i} {hot} {i}") for i in range(40))]
    items = [(1, hot), (2, hot[5:30]), (3, hot[4:18]), (4, "ve"), (5, ""), (6, None), (7, hot + "!"), (1, hot)]
    ddf = spark.createDataFrame(docs, "doc string, t string")
    idf = spark.createDataFrame(items, "item int, t string")
    want = {(d, i) for d, t in docs for i, u in items if t and u and u in t and d is not None}
    got = [(r["doc"], r["item"]) for r in C.flag_contained_holdout(ddf, idf, "doc", "t", "item", "t").collect()]
    assert set(got) == want and len(got) == len(want)
    assert C.flag_contained_holdout(ddf, idf.where("item > 9"), "doc", "t", "item", "t").count() == 0
    assert C.flag_contained_holdout(ddf.where("doc = 'z'"), idf, "doc", "t", "item", "t").count() == 0


def test_repetition_keeps_all_columns_and_rows(spark):
    rows = [(1, None, [1, 2]), (2, "", None), (3, "ab ab ab ab", [3]), (3, "ab ab ab ab", [3]), (4, "abcdefgh", [])]
    df = spark.createDataFrame(rows, "id long, t string, extra array<int>")
    out = C.with_repetition(df, "t", 2)
    assert out.columns == ["id", "t", "extra", "repetition"]
    got = [(r["id"], r["t"], r["extra"], round(r["repetition"], 6)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(*r, {1: 0.0, 2: 0.0, 3: round(1 - 2 / 7, 6), 4: 0.0}[r[0]]) for r in rows], key=repr)
    assert sorted(r["id"] for r in C.drop_repetitive(df, "t", 2).collect()) == [1, 2, 4]
    assert C.drop_repetitive(df, "t", 2).columns == df.columns
