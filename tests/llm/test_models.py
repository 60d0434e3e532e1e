"""Operators 1, 2, 6, 7 and 10 against brute force, the libraries and held-out labels."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import corpus, edge, nothing  # noqa: F401

from chatsieve.llm import jaccard_join, language_ecoc, piece_bpe, quality_zstd, token_orc
from chatsieve.llm.plans import TOKENIZERS

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(params=["edge", "corpus", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


# -- 1 ---------------------------------------------------------------------

def test_quality_scores_every_row(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality_zstd.held_out_scores(docs, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in texts(docs))
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = quality_zstd.held_out_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in seen if r["quality"] == 1]
    bad = [r["score"] for r in seen if r["quality"] == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert above / (len(good) * len(bad)) > 0.9


def test_quality_without_labels(edge, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_zstd.held_out_scores(edge, none).collect()} == {0.5}


# -- 2 ---------------------------------------------------------------------

def components_brute(rows, n, num, den):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for a, b in {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1:]}:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return [(i, len(sets[k]), min(low[find(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def test_near_components(docs):
    got = jaccard_join.near_components(docs, 3, 9, 10).collect()
    assert key(got) == key(components_brute(texts(docs), 3, 9, 10))


def test_near_components_of_large_regions(spark, monkeypatch):
    """A shared passage, a chain of edits and clusters around the threshold, with regions split early."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice((12, 30, 60)))] for _ in range(12)]
    passage = [rnd.choice(vocab) for _ in range(20)]
    rows = []
    for i in range(110):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w if rnd.random() < 0.6 else w + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_components(df, 1, 4, 5).collect()
    assert key(got) == key(components_brute(rows, 1, 4, 5))


def test_drop_near_duplicates_keeps_one_of_a_component(edge):
    out = jaccard_join.drop_near_duplicates(edge)
    assert out.columns == edge.columns
    ids = [i for i, _ in texts(out)]
    assert 6 in ids and 7 not in ids and 1 in ids and 2 in ids and ids.count(None) == 2


# -- 6 ---------------------------------------------------------------------

def tokens_brute(rows):
    t = Tokenizer.from_file(WORDS)
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


def test_token_files(docs):
    got = token_orc.tokenise(docs, WORDS).collect()
    assert key(got) == key(tokens_brute(texts(docs)))


def test_token_strings_match_whole_texts():
    t = Tokenizer.from_file(WORDS)
    rnd = random.Random(2)
    parts = ["The", "it's", "we'LL", "x.", ",", "'s", "É", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ",
             "<|endoftext|>", "<|ENDOFTEXT|>", "1", "42%", "a.b", "ß", "İ", "中", "\U0001f600", "don't.", "!!", "###", "|", "\x00"]
    for _ in range(4000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        ids = t.encode(s, add_special_tokens=False).ids + [2]
        assert token_orc.token_bytes(s, WORDS) == b"".join(x.to_bytes(4, "little") for x in ids), repr(s)


def test_token_strings_of_every_latin_letter():
    t = Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in range(0x80, 0x260) if chr(c).isalpha()]
    for s in [*letters, *(f"a{c}b" for c in letters), *(f"{a}{b}." for a, b in zip(letters, letters[1:]))]:
        ids = t.encode(s, add_special_tokens=False).ids + [2]
        assert token_orc.token_bytes(s, WORDS) == b"".join(x.to_bytes(4, "little") for x in ids), repr(s)


def test_token_reader_prunes_by_id(spark, corpus, tmpdir_path):
    path = f"{tmpdir_path}/tokens"
    token_orc.write_tokens(corpus, WORDS, path)
    some = token_orc.read_tokens(spark, path, [3, 77])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 77]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


# -- 7 ---------------------------------------------------------------------

def test_languages(docs):
    rows = language_ecoc.held_out_languages(docs).collect()
    text = defaultdict(list)
    for i, t in texts(docs):
        text[i].append(t)
    assert sum(map(len, text.values())) == len(rows)
    for r in rows:
        blank = [t is None or not any(c.isalpha() for c in t) for t in text[r["doc_id"]]]
        if all(blank):
            assert r["lang_pred"] == "und"
        if not any(blank):
            assert r["lang_pred"] != "und" and 0 < r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = language_ecoc.held_out_languages(docs).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in seen) / len(seen) > 0.97


def test_margins_do_not_depend_on_slices(monkeypatch):
    import numpy as np
    weights = np.random.default_rng(1).normal(size=(language_ecoc.SIZE, 3)).astype("float32")
    some = ["", "a", "hello world", "é" * 50, "x" * 333, "", "end"]
    whole = language_ecoc.margins(some, weights)
    alone = np.concatenate([language_ecoc.margins([t], weights) for t in some])
    assert np.allclose(whole, alone, atol=1e-5)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_ecoc, "SLICE", size)
        assert np.allclose(language_ecoc.margins(some, weights), whole, atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = language_ecoc.codewords(n)
    assert len({tuple(r) for r in code}) == n


# -- 10 --------------------------------------------------------------------

def test_round_trip(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in texts(docs):
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert key(piece_bpe.round_trip(docs, PIECES).collect()) == key(want)


def test_encode_and_decode_columns(edge):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    enc = piece_bpe.encode(edge, PIECES)
    assert key((r["doc_id"], list(r["ids"])) for r in enc.collect()) == key((i, sp.encode(t or "")) for i, t in texts(edge))
    dec = piece_bpe.decode(enc, PIECES).collect()
    assert key(dec) == key((i, sp.decode(sp.encode(t or ""))) for i, t in texts(edge))


def test_strings_match_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = piece_bpe.model(PIECES)
    rnd = random.Random(4)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "b", "the", "ing", "é", "é", "\x00", "\U0001f600", "中", "1", "23", "<s>",
             "<0x41>", "<unk>", "'s", ".", "..", ",", " ", "​", "    ", " " * 17, "Ñ", "http://", "##", "aaaaaaaa"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = sp.encode(t)
        assert piece_bpe.encode_text(t, PIECES) == ",".join(map(str, ids)), repr(t)
        assert m.decode(ids) == sp.decode(ids), repr(t)


def test_backtracking_equals_merging():
    m = piece_bpe.model(PIECES)
    rnd = random.Random(8)
    for _ in range(5000):
        s = "".join(rnd.choice("abcdehilnorstu▁") for _ in range(rnd.randint(1, 14))).replace("▁▁", "▁")
        assert m.backtrack(s) == m.merge(s), s


def test_paths():
    assert PIECES.endswith("piece_bpe_32k.model") and TOKENIZERS == "/opt/tokenizers"


# -- rows that share an id, languages of few texts -----------------------------

def test_near_copies_go_by_id_and_text(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]

    def prose():
        return " ".join(rnd.choice(words) for _ in range(120))

    a, other, third = prose(), prose(), prose()
    near = a + " end"
    rows = [(1, a), (2, near), (2, other), (3, third), (3, third + " x"), (None, a + " y"), (5, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, extra int")
    kept = {(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_duplicates(docs).collect()}
    assert (1, a) in kept and (2, other) in kept and (2, near) not in kept and (5, "") in kept
    assert len(kept & {(3, third), (3, third + " x")}) == 1 and (None, a + " y") in kept


def test_components_of_a_long_chain(spark):
    """Many steps, so the plan must not grow with them: labels are the smallest nodes."""
    links = [(i, i + 1) for i in range(0, 700)] + [(900, 950), (901, 950)]
    df = spark.createDataFrame(links, "a long, b long")
    out = jaccard_join.components(df)
    got = {r["node"]: r["comp"] for r in out.collect()}
    assert got == {**{i: 0 for i in range(701)}, 900: 900, 901: 900, 950: 900}
    assert len(out._jdf.queryExecution().toString()) < 20_000


def test_a_language_of_few_texts_in_many_copies_is_learned(spark):
    rnd = random.Random(2)
    alphabet = {"fr": "éàèuoil", "en": "thewsrk", "de": "üöäßchn"}

    def text(lang):
        return " ".join("".join(rnd.choice(alphabet[lang]) for _ in range(6)) for _ in range(40))

    rows = [("fr", t) for t in [text("fr") for _ in range(3)] for _ in range(1500)]
    rows += [(lang, text(lang)) for lang in ("en", "de") for _ in range(400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    out = language_ecoc.held_out_languages(docs).join(docs, "doc_id")
    wrong = out.where(F.col("lang_pred") != F.col("lang")).count()
    assert wrong <= 0.02 * len(rows)
