"""Operator 13 against the library, and the shared strings of the tokenizing operators."""
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_fixtures import corpus, edge, nothing  # noqa: F401

from chatsieve.llm import strings, token_count

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(params=["edge", "corpus", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_token_counts_match_the_library(docs):
    t = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 2048))
    out = token_count.count_tokens(docs, WORDS)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_strings_count_as_in_the_library():
    t, count, rnd = Tokenizer.from_file(WORDS), token_count.counter(WORDS), random.Random(5)
    parts = ["The", "it's", "we'LL", "x.", ",", "'s", "É", "é", "́", "\t", "\r", "\x1c", "\xa0", " ", "ΑΣ", "ς", "²", "½",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "1", "42%", "a.b", "ß", "İ", "ſ", "K", "中", "\U0001f600", "ª", "|", "\x00"]
    for _ in range(6000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)
    for c in range(1, 0x250):
        for s in (chr(c), f"a{chr(c)}", f"{chr(c)}a'{chr(c)}{chr(c)}1"):
            if c not in (10, 32):
                assert count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


def test_proven_strings_are_one_token():
    t, count = Tokenizer.from_file(WORDS), token_count.counter(WORDS)
    assert len(count.whole_texts) > 30_000
    some = random.Random(3).sample(sorted(count.whole_texts), 3000)
    assert all(len(e.ids) == 1 for e in t.encode_batch(some, add_special_tokens=False))
    assert {"the", "ing", "."} <= count.whole_texts
    assert all(len(t.encode(p, add_special_tokens=False).ids) > 1 for p in ("The-", "qzxv", "<|x"))


def test_a_full_table_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_count, "KNOWN_STRINGS", 3)
    count, t = token_count.Counter(WORDS), Tokenizer.from_file(WORDS)
    for s in ["zebrafishes", "Zebrafishes.", "unbelievability", "zebrafishes", "x" * 50, "Unbelievability!"] * 2:
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids)
    assert len(count.known) == 3


def test_files_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        strings.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_slices_cover_every_row_in_order():
    texts = ["", "a" * 100, "b", "c" * 5, None, "d" * 30, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([t or "" for t in texts])], names=["i", "t"])
    for most in (1, 10, 40, 1000):
        parts = list(strings.slices(batch, 1, most))
        assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7))
    assert len(list(strings.slices(batch, 1, 1000))) == 1


def test_runs_gather_and_sums():
    runs = strings.Runs([np.array(x, "<i4").tobytes() for x in ([1, 2], [], [7])], "<i4")
    values, n = runs.gather(np.array([2, 0, 1, 0]))
    assert values.tolist() == [7, 1, 2, 1, 2] and n.tolist() == [1, 2, 0, 2]
    words, codes, starts = strings.spelled(pa.array(["a b a", "", "b"]))
    assert [words[c] for c in codes] == ["a", "b", "a", "", "b"] and starts.tolist() == [0, 3, 4, 5]
    assert strings.sums_by_text(np.arange(5), starts).tolist() == [3, 3, 4]
