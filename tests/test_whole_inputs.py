"""No row is lost to null groups, long conversations, extreme fractions or odd vectors."""
import math

import pytest
from pyspark.sql import functions as F

from chatsieve.operators import clean as C
from chatsieve.operators import dataset as DS
from chatsieve.operators import metrics as M
from chatsieve.operators.ranking import exact_row_number, running_max
from chatsieve.operators.tokens import pad_batches


@pytest.fixture(scope="module")
def half_null(spark):
    return spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"))


def test_null_groups_stay(half_null):
    ranked = exact_row_number(half_null, ["g"], ["k"]).collect()
    assert len(ranked) == 100
    assert sorted(r["row_number"] for r in ranked if r["g"] is None) == list(range(1, 51))
    peaks = running_max(half_null, ["g"], ["k"], "k").collect()
    assert len(peaks) == 100 and all(r["running_max"] == r["k"] for r in peaks)
    split = DS.split_train_eval_exact(half_null, "k", 0.2, stratum="g").groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in split} == {
        ("a", "eval"): 10, ("a", "train"): 40, (None, "eval"): 10, (None, "train"): 40}
    assert DS.quota_sample(half_null, "g", "k", 50).count() == 50


def test_exact_split_without_stratum(half_null):
    split = DS.split_train_eval_exact(half_null, "k", 0.3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"eval": 30, "train": 70}


@pytest.mark.parametrize("fraction,low,high", [(1.0, 20000, 20000), (0.0, 0, 0), (0.5, 9700, 10300), (1e-3, 5, 50)])
def test_split_takes_any_fraction(spark, fraction, low, high):
    df = spark.range(20000)
    assert low <= DS.split_train_eval(df, "id", fraction).where("split = 'eval'").count() <= high


def test_split_below_a_millionth(spark):
    row = spark.range(1).select(F.conv(F.lit("0" * 8 + "10000"), 16, 10).cast("long").alias("h")).first()
    assert row["h"] < round(1e-6 * 2 ** 52)


def test_conversations_of_more_than_1000_turns(spark):
    turns = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"x{t}") for t in range(1202)]
        + [(2, t, "user" if t % 2 == 0 else "assistant", "yyyy") for t in range(4)],
        "conv_id long, turn long, role string, text string")
    pairs = C.extract_qa_pairs(turns)
    assert pairs.count() == 603
    runs = pairs.select("conv_id", "turn", F.lit("r").alias("run"), "answer")
    assert M.pair_answers(runs, ["conv_id", "turn"], "run", "answer", ["r"]).count() == 603
    two = pairs.where("conv_id = 2 or turn = 1000").select(
        "conv_id", "turn", F.lit("abc").alias("h"), F.when(F.col("conv_id") == 2, "abc").otherwise("xyz").alias("r"))
    row = M.corpus_char_bleu(two, "h", "r", ["conv_id", "turn"]).first()
    assert (row["num_rows"], row["num1"], row["den1"]) == (3, 6, 9)


def test_gaps_in_turns_can_be_closed(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 5, "assistant", "a"), (2, 3, "user", "q2"), (2, 9, "assistant", "a2")],
                                  "conv_id long, turn long, role string, text string")
    assert C.extract_qa_pairs(turns).count() == 0
    assert sorted(r["answer"] for r in C.extract_qa_pairs(C.with_dense_turns(turns)).collect()) == ["a", "a2"]


def test_padding_with_a_compound_key(spark):
    rows = [(c, t, list(range(1, n + 1))) for c, t, n in [(1, 1000, 3), (2, 0, 9), (1, 0, 1), (2, 1, 2)]]
    df = spark.createDataFrame(rows, "c long, t long, input_ids array<int>").select(
        "*", F.col("input_ids").alias("labels"), F.transform("input_ids", lambda _x: F.lit(1)).alias("attention_mask"))
    out = {(r["c"], r["t"]): (r["batch"], len(r["input_ids"])) for r in pad_batches(df, 2, ["c", "t"], multiple=8).collect()}
    assert out == {(1, 0): (0, 8), (1, 1000): (0, 8), (2, 0): (1, 16), (2, 1): (1, 16)}


def test_null_answers_are_present(spark):
    runs = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "y")], "id long, run string, answer string")
    assert [tuple(r) for r in M.pair_answers(runs, "id", "run", "answer", ["a", "b"]).collect()] == [(1, None, "x")]


def test_bertscore_of_zero_vectors_and_one_sided_samples(spark):
    rows = [(1, "cand", 0, [0.0, 0.0]), (1, "ref", 1, [1.0, 0.0]), (2, "cand", 0, [1.0, 0.0]),
            (3, "cand", 0, [1.0, 0.0]), (3, "ref", 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "sid long, side string, tok long, vec array<double>")
    out = {r["sid"]: (r["precision"], r["recall"], r["f1"]) for r in M.bertscore(df).collect()}
    assert out == {1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0)}


def test_bleu_smoothing_of_zero_counts(spark):
    df = spark.createDataFrame([(1, "abcdef", "fedcba")], "id long, h string, r string")
    row = M.corpus_char_bleu(df, "h", "r", "id").first()
    p = [6 / 6] + [math.log(6) / (5 * 2 ** z) / den for z, den in ((1, 5), (2, 4), (3, 3))]
    assert abs(row["bleu"] - math.exp(sum(map(math.log, p)) / 4)) < 1e-12


def test_short_holdout_items_need_no_nested_loop(spark):
    docs = spark.createDataFrame([(i, f"row {i} holds ab{i % 7} and xyz") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab3"), (2, "xyz"), (3, "q"), (4, "row 11 holds ab4"), (5, "é")], "item_id long, t string")
    hits = C.flag_contained_holdout(docs, items, "doc_id", "text", "item_id", "t")
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    want = {(i, k) for i, d in ((r["doc_id"], r["text"]) for r in docs.collect())
            for k, t in ((1, "ab3"), (2, "xyz"), (3, "q"), (4, "row 11 holds ab4")) if t in d}
    assert {tuple(r) for r in hits.collect()} == want


def test_duplicates_by_hash_are_confirmed_by_the_key(spark):
    rows = [(1, "a", "bc"), (2, "ab", "c"), (3, "a", "bc"), (4, None, "x"), (5, None, "x"), (6, "a|1", "b"), (7, "a", "1|b")]
    df = spark.createDataFrame(rows, "id long, p string, q string")
    assert sorted(r["id"] for r in C.drop_exact_duplicates(df, "id").collect()) == [1, 2, 4, 5, 6, 7]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chatsieve.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=sc)
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(fake)


def test_rank_of_numbers_and_texts(spark):
    from chatsieve.operators.runs import rank_key
    num = spark.createDataFrame([(16.0,), (7.9,), (float("nan"),), (None,)], "rank double")
    assert [r[0] for r in num.select(rank_key("rank", "double")).collect()] == [16, 7, 999, 999]
    text = spark.createDataFrame([("16",), ("16.0",), ("auto",), (None,)], "rank string")
    assert [r[0] for r in text.select(rank_key()).collect()] == [16, 999, 999, 999]
