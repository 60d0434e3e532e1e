"""Metrics against Python / NumPy statements; ranking helpers against windows;
invariants of sampling, splitting and the cleaning funnel."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatsieve.functions.clipped import clipped_matches
from chatsieve.operators import dataset as DS
from chatsieve.operators import metrics as M
from chatsieve.operators.clean import cleaning_funnel, funnel_counts
from chatsieve.operators.ranking import exact_row_number, running_max


def py_corpus_bleu(hyps, refs, k=5.0):
    num, den = [0] * 4, [0] * 4
    hl = rl = 0
    for h, r in zip(hyps, refs):
        h = list(re.sub(r"\s+", "", h))
        r = list(re.sub(r"\s+", "", r))
        hl += len(h)
        rl += len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            num[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            den[n - 1] += max(1, sum(hc.values()))
    if num[0] == 0:
        return 0.0, num, den
    bp = 1.0 if hl > rl else (0.0 if hl == 0 else math.exp(1 - rl / hl))
    p, zeros = [], 0
    for n in range(4):
        if num[n] == 0 and hl > 1:
            zeros += 1
            p.append(math.log(hl) / (2 ** zeros * k) / den[n])
        else:
            p.append(num[n] / den[n])
    return bp * math.exp(sum(0.25 * math.log(x) for x in p)), num, den


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_char_bleu_matches_python(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abcde退货😀 "
    rows = []
    for i in range(40):
        h = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        r = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30)))
        rows.append((i, "a" if i % 2 else "b", h, r))
    df = spark.createDataFrame(rows, "id int, corpus string, h string, r string")
    got = {x.corpus: x for x in M.corpus_char_bleu(df, "h", "r", "id", by=["corpus"]).collect()}
    for c in ("a", "b"):
        sub = [x for x in rows if x[1] == c]
        exp, num, den = py_corpus_bleu([x[2] for x in sub], [x[3] for x in sub])
        g = got[c]
        assert [g.num1, g.num2, g.num3, g.num4] == num
        assert [g.den1, g.den2, g.den3, g.den4] == den
        assert g.bleu == pytest.approx(exp, rel=1e-12, abs=1e-15)


def test_char_bleu_smoothing_and_zero(spark):
    rows = [(1, "abcd", "xbcx"), (2, "zz", "zzz")]   # no 3/4-gram matches -> smoothing
    df = spark.createDataFrame(rows, "id int, h string, r string")
    g = M.corpus_char_bleu(df, "h", "r", "id").collect()[0]
    exp, _, _ = py_corpus_bleu([x[1] for x in rows], [x[2] for x in rows])
    assert g.bleu == pytest.approx(exp, rel=1e-12)
    df0 = spark.createDataFrame([(1, "abc", "xyz")], "id int, h string, r string")
    assert M.corpus_char_bleu(df0, "h", "r", "id").collect()[0].bleu == 0.0


def pooled(rows):
    """Clipped matches by order, all rows of a key as one."""
    num, sides = [0] * 4, {}
    for key, h, r in rows:
        for side, t in enumerate((h, r)):
            for n in range(1, 5):
                sides.setdefault((key, n), (Counter(), Counter()))[side].update(t[i:i + n] for i in range(len(t) - n + 1))
    for (_key, n), (hc, rc) in sides.items():
        num[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
    return num


@pytest.mark.parametrize("by", [[], ["c"]])
def test_char_bleu_makes_no_row_a_gram(spark, by):
    df = spark.createDataFrame([(1, 0, "a", "abc", "abd")], "conv_id long, turn long, c string, h string, r string")
    plan = M.corpus_char_bleu(df, "h", "r", ["conv_id", "turn"], by)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_char_bleu_of_repeated_and_null_keys(spark):
    rows = [(1, "a", "abab", "ab"), (1, "a", "xy", "ababxy"), (None, "a", "qq", "q"), (None, "a", "q", "qqq"),
            (1, "b", "ab", None), (2, None, "😀退", "退😀退"), (3, None, None, "z")]
    df = spark.createDataFrame(rows, "id long, c string, h string, r string").repartition(3)
    got = {x.c: x for x in M.corpus_char_bleu(df, "h", "r", "id", by=["c"]).collect()}
    for c in ("a", "b", None):
        sub = [(k, h or "", r or "") for k, own, h, r in rows if own == c]
        assert [got[c][f"num{n}"] for n in range(1, 5)] == pooled(sub)
        assert got[c].num_rows == len(sub) and got[c].hyp_len == sum(len(h) for _k, h, _r in sub)


def test_char_bleu_of_a_key_longer_than_a_portion(spark):
    rnd = random.Random(4)
    rows = [(i // 90, "".join(rnd.choices("abcde退😀", k=9000)), "".join(rnd.choices("abcdexyz", k=9000))) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, h string, r string").coalesce(1)
    got = M.corpus_char_bleu(df, "h", "r", "id").first()
    assert [got[f"num{n}"] for n in range(1, 5)] == pooled(rows)
    assert (got.num_rows, got.den4) == (100, 100 * 8997)


@pytest.mark.parametrize("size", [1, 40, 300, 10 ** 6])
def test_clipped_matches_of_portions(size):
    rnd = random.Random(size)
    rows = [(k, "".join(rnd.choices("ab é", k=rnd.randint(0, 9))), "".join(rnd.choices("abc ", k=rnd.randint(0, 9))))
            for k in range(30) for _ in range(rnd.choice([1, 1, 2, 20]))]
    new = [i == 0 or rows[i - 1][0] != k for i, (k, _h, _r) in enumerate(rows)]
    k, h, r = zip(*rows)
    whole = pa.RecordBatch.from_arrays([pa.array(k), pa.array(new), pa.array(h), pa.array(r)], names=["k", "new", "h", "r"])
    names = ["k", "n", "g", "ch", "cr", *"1234", *"5678", "hyp", "ref", "rows"]
    out = [x for b in clipped_matches((whole.slice(i, 7) for i in range(0, len(rows), 7)), 0, 4, names, size) for x in b.to_pylist()]
    num = [sum(x[str(n)] for x in out) for n in range(1, 5)]
    grams = {}
    for x in out:
        if x["n"]:
            c = grams.setdefault((x["k"], x["n"], x["g"]), [0, 0])
            c[0], c[1] = c[0] + x["ch"], c[1] + x["cr"]
    for (_k, n, _g), c in grams.items():
        num[n - 1] += min(c)
    assert num == pooled(rows) and bool(grams) == (size <= 300)
    assert sum(x["rows"] for x in out) == len(rows) and sum(x["ref"] for x in out) == sum(map(len, r))
    assert sum(x["7"] for x in out) == sum(max(1, len(t) - 2) for t in h)


def test_bertscore_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for sid in range(5):
        for side in ("cand", "ref"):
            for t in range(rng.integers(1, 6)):
                rows.append((sid, side, f"{side}{t}", [float(x) for x in rng.normal(size=8)]))
    df = spark.createDataFrame(rows, "sid int, side string, tok string, vec array<double>")
    got = {r.sid: r for r in M.bertscore(df).collect()}
    for sid in range(5):
        c = np.array([v for s, sd, _, v in rows if s == sid and sd == "cand"])
        r = np.array([v for s, sd, _, v in rows if s == sid and sd == "ref"])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        sim = c @ r.T
        p, rc = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        assert got[sid].precision == pytest.approx(p, abs=1e-12)
        assert got[sid].recall == pytest.approx(rc, abs=1e-12)
        assert got[sid].f1 == pytest.approx(2 * p * rc / (p + rc), abs=1e-12)


def test_win_rate_nan_and_ties(spark):
    rows = [(0.1, 0.2), (0.3, 0.3), (0.5, 0.4), (float("nan"), 0.1), (0.2, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double")
    w = M.win_rate(df, "a", "b").collect()[0]
    a, b = np.array([x for x, _ in rows]), np.array([y for _, y in rows])
    assert (w.win, w.tie, w.lose, w.total) == (int((b > a).sum()), int((b == a).sum()), int((b < a).sum()), 5)
    assert w.win + w.tie + w.lose <= w.total


def test_token_accuracy_matches_python(spark):
    rows = [([1, 2, 3, 4, 5], [-100, -100, 3, 9, 5]), ([7, 7], [-100, -100]), ([1], [1])]
    df = spark.createDataFrame(rows, "p array<int>, l array<int>")
    g = M.masked_token_accuracy(df, "p", "l").collect()[0]
    cor = tot = 0
    for p, lab in rows:
        for x, y in zip(p[:-1], lab[1:]):
            if y != -100:
                tot += 1
                cor += int(x == y)
    assert (g.correct, g.total) == (cor, tot)
    assert g.mean_token_accuracy == pytest.approx(cor / tot)
    empty = M.masked_token_accuracy(df.where("false"), "p", "l").collect()[0]
    assert empty.mean_token_accuracy == 0.0


def test_positional_align_strict(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, a string")
    b = spark.createDataFrame([(0, "u")], "pos int, b string")
    assert M.positional_align(a, b, strict=False).count() == 1
    with pytest.raises(Exception):
        M.positional_align(a, b).collect()
    assert M.positional_align(a, a.withColumnRenamed("a", "b")).count() == 2


def test_rubric_and_comparison(spark):
    df = spark.createDataFrame([("r1", 1.0, 3.0), ("r1", 3.0, None), ("r2", 2.0, 2.0)],
                               "run string, accuracy double, empathy double")
    got = {(r.run, r.dimension): r.mean_score for r in M.rubric_rollup(df, ["accuracy", "empathy"], ["run"]).collect()}
    assert got == {("r1", "accuracy"): 2.0, ("r1", "empathy"): 3.0, ("r2", "accuracy"): 2.0, ("r2", "empathy"): 2.0}
    m = spark.createDataFrame([("base", 0.7, 0.5, 0.1, None), ("new", 0.72, 0.6, 0.0, 0.65)],
                              "run string, f1_mean double, must_have_pass_rate double, forbidden_hit_rate double, win_rate double")
    t = {(r.run, r.metric): r.value for r in M.comparison_table(m, baseline_run="base").collect()}
    assert t[("base", "Win Rate")] == 0.5 and t[("new", "1 - Forbidden Hit")] == 1.0


# ---------------------------------------------------------------- ranking
def _skewed(spark, n=3000):
    # one group holds a third of all rows
    rows = [(0 if i % 3 == 0 else i % 50 + 1, i, float((i * 7919) % 1000)) for i in range(n)]
    return spark.createDataFrame(rows, "g int, k long, v double")


def test_exact_row_number_matches_window_under_skew(spark):
    df = _skewed(spark)
    got = exact_row_number(df, ["g"], ["v", "k"], "rn", num_partitions=16)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "k")))
    j = got.join(ref, ["g", "k"])
    assert j.count() == 3000
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    glob = exact_row_number(df, [], ["k"], "rn", num_partitions=7).collect()
    assert sorted(r.rn for r in glob) == list(range(1, 3001))
    assert all(r.rn == r.k + 1 for r in glob)


def test_running_max_matches_window_under_skew(spark):
    df = _skewed(spark)
    got = running_max(df, ["g"], ["k"], "v", "rm", num_partitions=16)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rm2", F.max("v").over(w))
    j = got.join(ref, ["g", "k"])
    assert j.count() == 3000 and j.where(F.col("rm") != F.col("rm2")).count() == 0


# ---------------------------------------------------------------- invariants
def test_quota_sample_exact_and_without_repeats(spark):
    df = _skewed(spark)
    for n, floors in ((300, {}), (500, {7: 40}), (5000, {})):
        s = DS.quota_sample(df, "g", "k", n, seed=7, floors=floors).collect()
        assert len(s) == min(n, 3000)
        assert len({r.k for r in s}) == len(s)
        per = Counter(r.g for r in s)
        for g, f in floors.items():
            assert per[g] >= min(f, 60)
    counts = Counter(r.g for r in df.collect())
    s = Counter(r.g for r in DS.quota_sample(df, "g", "k", 300, seed=7).collect())
    for g, c in counts.items():
        assert abs(s[g] - 300 * c / 3000) < 1.0 + 1e-9


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    s = DS.split_train_eval(df, "k", 0.1, seed=42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] + counts["eval"] == 5000
    assert 400 < counts["eval"] < 600
    again = DS.split_train_eval(df, "k", 0.1, seed=42)
    assert s.exceptAll(again).count() == 0


def test_funnel_conserves_rows(spark):
    df = spark.createDataFrame([(i, "x" * (i % 30)) for i in range(200)], "id int, t string")
    tagged = cleaning_funnel(df, [("empty", F.length("t") == 0), ("short", F.length("t") < 10),
                                  ("odd", (F.col("id") % 2 == 1))])
    c = {r.reason: r.n for r in funnel_counts(tagged).collect()}
    assert sum(c.values()) == 200
    assert set(c) == {"empty", "short", "odd", "kept"}


def test_sample_rows_all_or_prefix(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert DS.sample_rows(df, None, "k").count() == 100
    assert DS.sample_rows(df, 0, "k").count() == 100
    assert DS.sample_rows(df, 500, "k").count() == 100
    a = [r.k for r in DS.sample_rows(df, 10, "k", seed=3).collect()]
    b = [r.k for r in DS.sample_rows(df, 10, "k", seed=3).collect()]
    assert a == b and len(set(a)) == 10


SF01 = "/root/testdata/sf0.01"


@pytest.mark.skipif(not __import__("os").path.exists(SF01), reason="sf0.01 not available")
def test_bleu_counts_equal_independent_probe(spark):
    """Counts over the 135 answer pairs (next vs later answer) at sf0.01 equal
    the figures computed independently with plain Python and DuckDB."""
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    u = conv.where("role = 'user'").select("conv_id", "turn")
    nxt = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("h"))
    later = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("r"))
    j = u.join(nxt, ["conv_id", "turn"]).join(later, ["conv_id", "turn"]) \
        .withColumn("rid", F.col("conv_id") * 1000 + F.col("turn"))
    c = M.bleu_counts(j, "h", "r", "rid").collect()[0]
    assert c.num_rows == 135
    assert [c.num1, c.num2, c.num3, c.num4] == [69671, 61192, 45282, 24770]
    assert [c.den1, c.den2, c.den3, c.den4] == [103233, 103098, 102963, 102828]


def test_accuracy_from_scores_in_chunks(spark):
    """First maximum over all chunks, ties, missing chunks and masked labels, against plain lists."""
    import random
    from chatsieve.operators import metrics as M
    from chatsieve.operators import tokens as TK
    rnd = random.Random(6)
    scores = {(r, p): [rnd.randrange(4) for _ in range(12)] for r in range(20) for p in range(rnd.randrange(1, 7))}
    chunks = [(r, p, i, [float(x) for x in v[i:i + 5]]) for (r, p), v in scores.items() for i in (0, 5, 10)]
    df = spark.createDataFrame([*chunks, (99, 0, 0, [])], "row int, pos int, first int, scores array<double>").repartition(5)
    preds = TK.chunked_predictions(df, ["row", "pos"])
    want = {k: v.index(max(v)) for k, v in scores.items()}
    assert {(x["row"], x["pos"]): x["pred"] for x in preds.collect()} == want
    labels = [(r, p, rnd.choice([-100, 0, 1, 2])) for r, p in scores]
    ldf = spark.createDataFrame(labels, "row int, pos int, label int")
    pairs = [(want[r, p - 1], x) for r, p, x in labels if x != -100 and p > 0]
    got = M.positional_token_accuracy(preds, ldf, "row").first()
    assert (got["correct"], got["total"]) == (sum(a == b for a, b in pairs), len(pairs))
    none = M.positional_token_accuracy(preds, ldf.where("label = -100"), "row").first()
    assert (none["correct"], none["total"], none["mean_token_accuracy"]) == (0, 0, 0.0)
