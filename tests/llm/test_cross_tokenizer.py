"""Operator 11 against a plain alignment by the libraries."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_fixtures import corpus, edge, nothing  # noqa: F401

from chatsieve.llm import cross_tokenizer, token_units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> None, or ids a, ids b, groups text, list of links; everything by the libraries and token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: i for i, c in token_units.byte_letters().items()}

    def of_a(i):
        return bytes(letter[c] for c in a.id_to_token(i))

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def align(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [of_a(i) for i in ids[0]], [of_b(i) for i in ids[1]]
        if any(b"".join(x) != (" " + text).encode() for x in spelled):
            return None
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        links, i, j, groups, from_i, from_j = [], 0, 0, [], 0, 0
        while i < len(ids[0]):
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids[0][from_i:i])) + "|" + ",".join(map(str, ids[1][from_j:j])))
                from_i, from_j = i, j
        return ids[0], ids[1], groups, links

    return align


def brute(rows, align):
    aligned = [(doc_id, align(text)) for doc_id, text in rows]
    held = Counter(p for _, x in aligned if x for p in set(x[3]))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if x is None else
            (d, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(held[p] == top[p[0]] for p in x[3]),
             sum(held[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for d, x in aligned], held, top


@pytest.mark.parametrize("name", ["edge", "corpus", "nothing"])
def test_alignment_equals_the_plain_one(name, request, plain):
    docs = request.getfixturevalue(name)
    want, held, top = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], plain)
    out = cross_tokenizer.align_tokenizers(docs, A, B)
    assert out.columns == ["doc_id", *cross_tokenizer.NUMBERS, "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    if name != "edge":
        pairs = cross_tokenizer.aligned_pairs(docs, A, B).collect()
        assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in pairs} == {
            p: (n, n == top[p[0]]) for p, n in held.items()}


def test_odd_texts_and_a_deep_tree(spark, plain, monkeypatch):
    """Many small parts, so that counts go up several levels; texts with all sorts of white space and marks."""
    rnd = random.Random(1)
    parts = ["The", "it's", "we'LL", "x.", ",", "'s", "É", "é", "́", "\t", "\r", "\x1c", "\xa0", " ", " ", "  ", "\n", "\n\n",
             "²", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "1", "42%", "İ", "中", "\U0001f600", "\x00",
             "supercalifragilistic", "　", "''", "don't", "\x85", "a" * 60]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))) for i in range(1500)]
    want, _, _ = brute(rows, plain)
    assert sum(1 for w in want if w[1]) > 500
    monkeypatch.setattr(cross_tokenizer, "FAN_IN", 3)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(11)
    assert sorted(map(tuple, cross_tokenizer.align_tokenizers(docs, A, B).collect())) == sorted(want)


def test_full_tables_change_nothing(monkeypatch):
    pair = token_units.Pair(A, B)
    texts = pa.array(["Some unusual words, zebrafishes and quokkas.", "zebrafishes quokkas", "a ▁ b", ""])

    def numbers():
        return [(r.tolist(), links.n_a[c].tolist(), links.groups()) for r, c, _, links in token_units.Texts(pair, texts).parts]

    full = numbers()
    monkeypatch.setattr(token_units, "KNOWN_UNITS", 0)
    pair.units.clear()
    pair.merged.clear()
    assert numbers() == full and not pair.units and not pair.merged


def test_perfect_hash():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        h = cross_tokenizer.PerfectHash.of(keys)
        h = cross_tokenizer.PerfectHash.from_bytes(h.to_bytes(), h.keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        assert (h.keys[h.slots(keys)] == keys).all()
        other = np.setdiff1d(rnd.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32), keys)
        assert (h.slots(other) == -1).all()


def test_counts_beyond_32_bits():
    for counts in ([], [1, 2], [1, 1 << 33]):
        x = np.array(counts, np.int64)
        assert cross_tokenizer.widened(cross_tokenizer.narrow(x), len(x)).tolist() == counts
