"""Operators 3, 4, 5, 8 and 9 against plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import corpus, edge, nothing  # noqa: F401

from chatsieve.llm import exact_dedup, license_scan, pii, pivotal_mix, weak_rules
from chatsieve.llm.common import write_and_read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(params=["edge", "corpus", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


# -- 3 ---------------------------------------------------------------------

def dedup_brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
def test_exact_duplicates(docs, keep, pick):
    got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
    assert key(got) == key(dedup_brute(texts(docs), pick))


def test_exact_duplicates_tells_collisions_apart(edge):
    got = exact_dedup.exact_duplicates(edge, keep="max", hash_expr=lambda t: F.length(t) % 2).collect()
    assert key(got) == key(dedup_brute(texts(edge), max))


def test_drop_exact_copies_keeps_one_row_of_each_text(edge):
    out = exact_dedup.drop_exact_copies(edge, keep="max")
    assert out.columns == edge.columns
    left = [t or "" for _, t in texts(out)]
    assert sorted(left) == sorted({t or "" for _, t in texts(edge)})


# -- 4 ---------------------------------------------------------------------

def counts_brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, n < 50 or 100 * rep > 50 * n)


def test_quality_counts(docs):
    got = weak_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed").collect()
    assert key(got) == key([(i, *counts_brute(t)) for i, t in texts(docs)])


def test_quality_verdict_is_the_em_posterior(corpus):
    """The fitted model again in plain Python over the same votes."""
    import math
    counts = write_and_read(weak_rules.text_counts(corpus).withColumns(weak_rules.votes()), "test-votes")
    usable = counts.where(~weak_rules.base_failed()).select("doc_id", *weak_rules.RULES).collect()
    post = {r["doc_id"]: 0.1 if -1 in tuple(r)[1:] else 0.95 for r in usable}
    for _ in range(weak_rules.ITERATIONS):
        g = sum(post.values())
        prior = (g + 1) / (len(usable) + 2)
        rate = {}
        for cls, (b0, g0) in weak_rules.PRIOR.items():
            weight = (lambda i: post[i]) if cls == "good" else (lambda i: 1 - post[i])
            for r in weak_rules.RULES:
                bad = sum(weight(x["doc_id"]) for x in usable if x[r] == -1)
                ok = sum(weight(x["doc_id"]) for x in usable if x[r] == 1)
                rate[cls, r] = (bad + b0) / (bad + ok + b0 + g0)
        for x in usable:
            logit = math.log(prior / (1 - prior))
            for r in weak_rules.RULES:
                a, b = rate["good", r], rate["bad", r]
                logit += math.log(a / b) if x[r] == -1 else math.log((1 - a) / (1 - b)) if x[r] == 1 else 0
            post[x["doc_id"]] = 1 / (1 + math.exp(-logit))
    got = weak_rules.judge(corpus).collect()
    for r in got:
        if not r["base_failed"]:
            assert abs(r["posterior"] - post[r["doc_id"]]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_quality_keeps_prose_and_drops_junk(spark):
    import random
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    def prose():
        return " ".join(rnd.choice(vocab) + ("." if rnd.random() < 0.1 else "") for _ in range(150))
    rows = [(i, prose()) for i in range(300)]
    rows += [(1000 + i, " ".join(x + "###" for x in prose().split())) for i in range(20)]
    rows += [(2000 + i, " ".join(x.upper() + "!!" for x in prose().split())) for i in range(20)]
    out = {r["doc_id"]: r["kept"] for r in weak_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(v == (i < 1000) for i, v in out.items())


def test_quality_verdict_does_not_depend_on_corpus_size(spark):
    mix = [((1, 1, 0, 0, 0, 0, 1, 0), 700), ((0, 1, 0, 0, 0, 0, 1, 0), 200), ((0, -1, -1, 0, 0, 0, 1, 0), 30),
           ((0, 1, 0, 0, 0, -1, 1, -1), 30), ((0, 1, 0, -1, 0, 0, 1, 0), 20), ((0, 1, 0, 0, -1, 0, 1, 0), 20)]
    seen = []
    for times in (1, 1000):
        df = spark.createDataFrame([(*v, n * times) for v, n in mix], ", ".join(f"{r} int" for r in weak_rules.RULES) + ", n long")
        df = df.coalesce(1)
        rows = df.withColumn("p", weak_rules.posterior_good(weak_rules.fit(df))).collect()
        seen.append({tuple(r)[:8]: r["p"] for r in rows})
        for v, p in seen[-1].items():
            assert (p >= 0.5) == (-1 not in v)
    assert all(abs(p - seen[1][v]) < 1e-9 for v, p in seen[0].items())


# -- 5 ---------------------------------------------------------------------

LWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_brute(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = LWORD.findall(t)
    places = [(i, label) for label, phrase in license_scan.BASE for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def test_license_base(docs):
    got = license_scan.license_digest(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert key(got) == key([(i, *base_brute(t)) for i, t in texts(docs)])


def test_license_spans_survive_an_inserted_word(spark):
    fill = "alpha beta gamma delta " * 5
    rows = [(1, fill + "Redistribution and use in source and also binary forms with or without modification are permitted. " + fill),
            (2, fill), (3, "the Kelvin sign in Kind does not spell kind")]
    out = {r["doc_id"]: r for r in license_scan.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["labels"] == "bsd" and 0.7 <= out[1]["score"] <= 1.0
    assert out[2]["labels"] == "" and out[2]["score"] == 0.0
    assert out[3]["labels"] == ""


# -- 8 ---------------------------------------------------------------------

def targets_brute(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal = {s: 0.0 for s in order}
    rest, open_ = 1.5 * sum(sizes.values()), set(order)
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            goal[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if goal[s] >= 2 * sizes[s]:
                rest += goal[s] - 2 * sizes[s]
                goal[s] = 2.0 * sizes[s]
                open_.discard(s)
    return goal


def test_mix(docs):
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    goal = targets_brute(sizes)
    out = pivotal_mix.mix(docs).collect()
    assert key([(r["doc_id"], r["size"], r["source"], r["source_size"]) for r in out]) == key(
        [(i, n, s, sizes[s]) for i, n, s in rows])
    taken = Counter()
    for r in out:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in goal:  # off by less than one document
        assert abs(taken[s] - goal[s]) <= max(n for _, n, x in rows if x == s) + 1e-6
    again = pivotal_mix.mix(docs.repartition(5)).collect()
    assert key(again) == key(out)


def test_mix_is_a_tree_over_many_blocks(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"),
                                  F.concat(F.lit("s"), (F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7)).cast("string")).alias("source"))
    out = pivotal_mix.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 3 for r in out)


def test_mixed_documents_repeats_rows(edge):
    plan = Counter()
    for r in pivotal_mix.mix(edge).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = pivotal_mix.mixed_documents(edge)
    assert got.columns == edge.columns
    seen = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in got.collect())
    assert seen == +plan


# -- 9 ---------------------------------------------------------------------

def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


GIVEN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_brute(t):
    out = []
    for no, (kind, pattern) in enumerate(GIVEN.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def digest(t):
    sp = spans_brute(t)
    n = Counter(k for k, _, _ in sp)
    return (*[n[k] for k in GIVEN], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in sp).encode()).hexdigest())


def test_personal_data_base(docs):
    got = pii.personal_data_digest(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert key(got) == key([(i, *digest(t)) for i, t in texts(docs)])


def test_personal_data_base_on_hard_strings(spark):
    import random
    rnd = random.Random(5)
    parts = ["a@b.c", ".@d.e", "a@@b.c", "1.2.3.4", ".5", "1.2.3.4.5.6.7.8", "256.1.1.1", "4539148803436467", " ", "-",
             "- -", "4539 1488 0343 6467", "5", "+", "+1 (830) 555-5433", "+49 30-1234567", "x", "é\U0001f600", "\n",
             "000000000001.2.3.4", "()", "00", "a" * 50, "%", "378282246310005 0"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))) for i in range(1500)]
    rows += [(9000, "a@b.co " * 3000), (9001, "7" * 200000), (9002, "a" * 200000 + "@"), (9003, "1 " * 100000),
             (9004, "+1" + "(" * 100000), (9005, "a@b" + ".c" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.personal_data_digest(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    want = dict((i, digest(t)) for i, t in rows if i not in (9001, 9002))
    want[9001] = want[9002] = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest())  # too slow for the plain patterns
    bad = [(r["doc_id"], tuple(r)[1:], want[r["doc_id"]]) for r in got if tuple(r)[1:] != want[r["doc_id"]]]
    assert not bad, (bad[:3], [t for i, t in rows if i == bad[0][0]])


def test_personal_data_added_kinds(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00"),
            (2, "my SSN is 123-45-6789 but 123-45-6780 12345678901234567890123456789012345678901 no"),
            (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" then 24be64439e3e49cf46b2d7c90f3602a3d0b907ff')]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == "iban:5:32"
    assert out[2].startswith("ssn:10:21")
    assert out[3].split(",")[0] == "secret:9:49"


def test_personal_data_context_spans_earlier_matches(spark):
    rows = [(1, "SSN: 123-45-6789, 987-65-4321, 123-45-6780"), (2, "tokens: a1b2c3d4e5f6g7h8i9j0 b1b2c3d4e5f6g7h8i9j0"),
            (3, "secret aaaaaaaaaaaaaaaaaaaaaaaa a1b2c3d4e5f6g7h8i9j0"),
            (4, "SSN 123-45-6789" + " " * 40 + "987-65-4321")]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "ssn:5:16,ssn:18:29,ssn:31:42", 2: "secret:8:28,secret:29:49", 3: "secret:32:52", 4: "ssn:4:15"}


def test_personal_data_iban_before_other_words(spark):
    es, be, de = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"{es} BIC CAIXESBB"), (2, f"{be} BIC KREDBEBB"), (3, f"{be} 2024"), (4, f"{es}."), (5, f"{es} {be} {de} 12"),
            (6, es.replace(" ", "")), (7, be.replace(" ", "") + "A"), (8, be[:-1] + "5 BIC")]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "iban:0:29", 2: "iban:0:19", 3: "iban:0:19", 4: "iban:0:29", 5: "iban:0:29,iban:30:49,iban:50:77",
                   6: "iban:0:24", 7: "", 8: ""}
