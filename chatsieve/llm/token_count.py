"""Token counts by the whole-token shortcut.

Most words of a text are entries of the vocabulary.  For each entry that ends
a word, encoding its string alone proves once a worker whether the tokenizer
gives back this one token.  Proven strings count one without being merged;
the pre-tokens of all other strings are looked up the same way, and only those
that are no proven string are merged.

White space separates pre-tokens and is dropped by the tokenizer, so a text is
the sum of its strings between spaces and line ends: Arrow splits and
dictionary-encodes them, each distinct string of a slice is counted once, and
the counts of a text are a gather and a sum.  Strings that hold a special
token go through the library whole.  No shuffle; a worker's table of known
strings is bounded.

Defined results: null and empty texts have no bytes and no tokens; very long
texts are slices of their own and are read whole; repeated rows are counted
alike; ties do not occur; an empty table gives an empty result; other columns
are ignored.  The tokenizer file must drop white space (checked at the start).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chatsieve.llm.common import id_and_text, ship_package
from chatsieve.llm.strings import LONGEST_KNOWN, WordTokenizer, slices, spelled, sums_by_text

KNOWN_STRINGS = 1_000_000  # strings and pre-tokens in a worker's table, about 100 MB
LIMIT = 2048


class Counter:
    """Number of tokens of a string without spaces."""

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer(path)
        self.whole, self.whole_texts = self.prove()
        self.known: dict[str, int] = {}

    def prove(self) -> tuple[frozenset[str], frozenset[str]]:
        """The pre-tokens (in byte letters) that merge to one token, and the texts that are encoded as one."""
        tk = self.tokenizer
        suffix = tk.model.end_of_word_suffix or ""
        byte_of = {letter: b for b, letter in tk.letters.items()}
        words = [(v[:len(v) - len(suffix)], i) for v, i in tk.library.get_vocab(with_added_tokens=False).items()
                 if v.endswith(suffix) and len(v) > len(suffix)]
        whole = [(v, i) for v, i in words if all(c in byte_of for c in v) and tk.merge(v) == [i]]
        texts = [bytes(byte_of[c] for c in v).decode("utf-8", "replace") for v, _ in whole]
        coded = tk.library.encode_batch(texts, add_special_tokens=False)
        return (frozenset(v for v, _ in whole),
                frozenset(t for t, (_, i), e in zip(texts, whole, coded) if e.ids == [i]))

    def __call__(self, s: str) -> int:
        if s in self.whole_texts:
            return 1
        n = self.known.get(s)
        if n is None:
            n = self.remembered(s) if s else 0
        return n

    def remembered(self, s: str) -> int:
        """Count ``s``: pre-tokens that are whole tokens count one, the others are merged."""
        if self.tokenizer.has_added(s):
            n = len(self.tokenizer.encode(s))
        else:
            n, known = 0, self.known
            for p in self.tokenizer.pre_tokens(s):
                if p in self.whole:
                    n += 1
                else:
                    m = known.get("\n" + p)  # no string has a line end, so pre-tokens keep apart
                    if m is None:
                        m = self.remember("\n" + p, len(self.tokenizer.merge(p)))
                    n += m
        return self.remember(s, n)

    def remember(self, s: str, n: int) -> int:
        if len(self.known) < KNOWN_STRINGS and len(s) < LONGEST_KNOWN:
            self.known[s] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    df = id_and_text(docs, id_col, text_col)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            for b in slices(batch, 1):
                strings, codes, starts = spelled(pc.replace_substring(b.column(1), "\n", " "))
                n = sums_by_text(np.fromiter(map(count, strings), np.int64, len(strings))[codes], starts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
