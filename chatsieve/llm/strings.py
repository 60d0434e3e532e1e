"""Distinct strings of Arrow batches, for the tokenizing operators.

A batch is cut into slices of bounded bytes.  The texts of a slice are split
and dictionary-encoded in Arrow, so a tokenizer sees each distinct string of a
slice once and Python does no step for each word: results come back to the
texts as gathers by code.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE_BYTES = 8 << 20
LONGEST_KNOWN = 40  # characters of a string that a worker's table remembers
LATIN = "\u0250"  # below it all letters are composed, and tests compare each of them with the library
# The settings of a tokenizer file for which pre-tokens are found here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of its string column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def spelled(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts, code of each part in order, place of each text's first code and the end).

    Parts are what lies between spaces of ``texts``; empty ones are kept.
    """
    parts = pc.split_pattern(texts, " ")
    starts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts.astype(np.int64)


def sums_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's codes (texts have one at least, but an empty sum is 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Runs:
    """Arrays of different lengths, given as bytes, in one pool; gathered by code."""

    def __init__(self, arrays: list[bytes], dtype):
        size = np.dtype(dtype).itemsize
        self.length = np.fromiter(map(len, arrays), np.int64, len(arrays)) // size
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(arrays), dtype)

    @classmethod
    def of(cls, pool: np.ndarray, length: np.ndarray, start: np.ndarray | None = None) -> "Runs":
        out = cls([], pool.dtype)
        out.pool, out.length, out.start = pool, length, np.cumsum(length) - length if start is None else start
        return out

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all ``codes`` one after the other, number of values of each code)."""
        n = self.length[codes]
        ends = np.cumsum(n)
        shift = np.repeat(self.start[codes] - ends + n, n)
        return self.pool[shift + np.arange(len(shift))], n


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """A ``tokenizers`` file that drops white space, so the strings between it are independent.

    The file must do so (checked).  ``pre_tokens`` finds the pre-tokens of a string
    itself where the file's normaliser and splitter are those this module knows
    and all characters are Latin; else the library finds them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        alone = [self.encode(s) for s in ("it's", "2nd,", "(so)")]
        if self.encode("  it's\n2nd,\t (so) \n") != sum(alone, []):
            raise ValueError(f"{path}: white space is part of tokens")
        self.letters = byte_letters()
        self.pattern = self._known_pattern(json.loads(self.library.to_str()))
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.added_words = any(map(str.isalnum, added))

    @staticmethod
    def _known_pattern(settings: dict):
        split, byte_level = ((settings["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        known = ((settings["normalizer"] or {}).get("normalizers") == LOWERED
                 and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
                 and split.get("pattern") == {"Regex": WORDS} and byte_level.get("type") == "ByteLevel"
                 and not byte_level.get("add_prefix_space") and not byte_level.get("use_regex"))
        return regex.compile(WORDS) if known else None

    def encode(self, s: str) -> list[int]:
        return self.library.encode(s, add_special_tokens=False).ids

    def has_added(self, s: str) -> bool:
        """Whether a special token's string stands in ``s``; such strings go through the library whole."""
        if self.added is None or s.isalnum() and not self.added_words:
            return False
        return self.added.search(s) is not None

    def pre_tokens(self, s: str) -> list[str]:
        """Pre-tokens of ``s``, which has no special token, in byte letters."""
        if self.pattern and s and max(s) < LATIN:
            low = s.lower()
            if low.isalpha():
                found = [low]
            elif low[:-1].isalpha() and low[-1].isprintable():
                found = [low[:-1], low[-1]]
            else:
                found = self.pattern.findall(low)
            if low.isascii() and low.isprintable():
                return found
            return [p.encode().decode("latin-1").translate(self.letters) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(s))]

    def merge(self, pre_token: str) -> list[int]:
        return [t.id for t in self.model.tokenize(pre_token)]
