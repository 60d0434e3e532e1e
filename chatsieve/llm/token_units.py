"""Two tokenizers over the same text: ids by unit, and the links between them.

``space + text`` is cut into units before every single space or line end that
stands between two characters that are no white space.  No token of either
tokenizer reaches across such a place (checked when a worker loads the files),
so units are encoded alone, each distinct one of a slice once, and remembered
in a bounded table.  A text that cannot be cut like that, or has a unit whose
tokens do not give its bytes back, is encoded whole by the libraries.

Two tokenizations of one unit overlap in as many pairs as their token ends have
distinct places, and their groups end where both have one, so all units of a
slice are aligned at once with sorted arrays of ends.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chatsieve.llm.strings import LATIN, LONGEST_KNOWN, Runs, byte_letters, spelled

KNOWN_UNITS = 300_000  # units, and as many pre-tokens, in a worker's tables
MARK = "▁"  # stands for a space in the second tokenizer's pieces
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
PROBES = ["a  b\n\nc \n d", " ab cd.\nEf\n12 's", "x\t\n y é, 中文 　z\r\nq"]


class Pair:
    """The two tokenizers of a worker: ``a`` for ``space + text``, ``b`` for ``text``."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()
        byte_of = {letter: i for i, letter in self.letters.items()}
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        names = [self.a.id_to_token(i) or "" for i in range(self.n_a)]
        self.a_bytes = Runs([bytes(byte_of[c] for c in v) if all(c in byte_of for c in v) else b"" for v in names], "u1")
        self.b_bytes = Runs([self._piece_bytes(i) for i in range(self.n_b)], "u1")
        self.lead = self.b.piece_to_id(MARK)
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.merged: dict[str, bytes] = {}
        self.cuts = self._can_cut()
        self.plain = self.cuts and self.a.normalizer is None and "ByteLevel" in repr(self.a.pre_tokenizer)

    def _piece_bytes(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()

    def _can_cut(self) -> bool:
        """Whether the parts of a cut text have the tokens of the whole."""
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b) if not self.b.is_byte(i)]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
            return False
        for text in PROBES:
            units = CUT.split(" " + text)
            a, b = zip(*map(self.whole, units))
            if (b"".join(a), b"".join(b)) != self.whole(" " + text):
                return False
        return True

    def whole(self, unit: str) -> tuple[bytes, bytes]:
        """Ids of a unit by the libraries."""
        return (_packed(self.a.encode(unit, add_special_tokens=False).ids), self.b_ids(unit, self.b.encode(_bare(unit))))

    def b_ids(self, unit: str, ids: list[int]) -> bytes:
        """The library puts a mark in front: it stands for a unit's space, and goes where the unit begins otherwise."""
        return _packed(ids if unit[:1] == " " else ids[1:] if ids[:1] == [self.lead] else [])

    def a_ids(self, unit: str) -> bytes:
        word = unit[1:]
        if not self.plain:
            return _packed(self.a.encode(unit, add_special_tokens=False).ids)
        if unit[0] == " " and word and max(word) < LATIN:
            if word.isalpha():
                return self.a_merged(self.spell(unit))
            if word[:-1].isalpha() and word[-1].isprintable():  # a letter run, then a digit or mark
                return self.a_merged(self.spell(unit[:-1])) + self.a_merged(self.spell(word[-1]))
        return b"".join([self.a_merged(p) for p, _ in self.a.pre_tokenizer.pre_tokenize_str(unit)])

    def spell(self, pre_token: str) -> str:
        """In byte letters."""
        return pre_token.encode().decode("latin-1").translate(self.letters)

    def a_merged(self, pre_token: str) -> bytes:
        out = self.merged.get(pre_token)
        if out is None:
            out = _packed([t.id for t in self.a.model.tokenize(pre_token)])
            if len(self.merged) < KNOWN_UNITS and len(pre_token) < LONGEST_KNOWN:
                self.merged[pre_token] = out
        return out

    def encoded(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both tokenizers' ids of each unit; None where they do not give its bytes, or it is no unit.

        A unit that begins with a space may be given without it; the table keeps those that are good.
        """
        out = list(map(self.units.get, units))
        new = [i for i, x in enumerate(out) if x is None]
        full = [_full(units[i]) for i in new]
        new = [i for i, u in zip(new, full) if u is not None]
        full = [u for u in full if u is not None]
        b = list(map(self.b_ids, full, self.b.encode(list(map(_bare, full)), num_threads=1)))
        both = list(zip(map(self.a_ids, full), b))
        raw = Runs([u.encode() for u in full], "u1")
        good = (same_bytes(raw, Runs([x for x, _ in both], "i4"), self.a_bytes)
                & same_bytes(raw, Runs(b, "i4"), self.b_bytes))
        room = KNOWN_UNITS - len(self.units)
        for i, ids, fine in zip(new, both, good.tolist()):
            if fine:
                out[i] = ids
                if room > 0 and len(units[i]) < LONGEST_KNOWN:
                    self.units[units[i]] = ids
                    room -= 1
        return out


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _full(unit: str) -> str | None:
    """The whole unit, or None where what stands between two spaces touches more white space."""
    if unit[:1] == " ":
        return unit
    unit = unit if unit[:1] == "\n" else " " + unit
    return unit if len(unit) > 1 and not unit[1].isspace() and not unit[-1].isspace() else None


def _bare(unit: str) -> str:
    return unit[1:] if unit[:1] == " " else unit


@lru_cache(maxsize=2)
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Links:
    """All links of the units whose ids are given: ids of their tokens, the links' two ids, and numbers by unit."""

    def __init__(self, pair: Pair, ids: list[tuple[bytes, bytes]]):
        a, b = Runs([x for x, _ in ids], "i4"), Runs([y for _, y in ids], "i4")
        self.a_ids, self.b_ids, self.n_a, self.n_b = a.pool, b.pool, a.length, b.length
        self.a_ends = np.cumsum(pair.a_bytes.length[a.pool])
        self.b_ends = np.cumsum(pair.b_bytes.length[b.pool])
        ends = np.concatenate([self.a_ends, self.b_ends])
        ends.sort(kind="stable")  # two runs: one merge
        again = ends[1:] == ends[:-1]
        self.common = ends[1:][again]
        ends = ends[np.concatenate([~again, [True]])] if len(ends) else ends
        self.link_a = a.pool[np.searchsorted(self.a_ends, ends)]
        self.link_b = b.pool[np.searchsorted(self.b_ends, ends)]
        last = np.searchsorted(ends, self.a_ends[np.cumsum(a.length) - 1]) if len(ids) else np.empty(0, np.int64)
        self.n_links = np.diff(last + 1, prepend=0)
        self.n_groups = self.n_a + self.n_b - self.n_links

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        a = joined(as_text(self.a_ids), np.searchsorted(self.a_ends, self.common, "right"), ",")
        b = joined(as_text(self.b_ids), np.searchsorted(self.b_ends, self.common, "right"), ",")
        return joined(pc.binary_join_element_wise(a, b, pa.scalar("|", pa.large_string())), np.cumsum(self.n_groups), ";").to_pylist()


def as_text(ids: np.ndarray) -> pa.Array:
    return pa.array(ids).cast(pa.large_string())


def joined(strings: pa.Array, ends: np.ndarray, sep: str) -> pa.Array:
    """The strings up to each of ``ends``, joined."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), strings)
    return pc.binary_join(lists, pa.scalar(sep, pa.large_string()))


def subset(runs: Runs, keep: np.ndarray) -> Runs:
    pool, _ = runs.gather(keep)
    return Runs.of(pool, runs.length[keep])


def same_bytes(raw: Runs, ids: Runs, vocabulary: Runs) -> np.ndarray:
    """For each unit, whether its tokens' bytes are its own."""
    pool, sizes = vocabulary.gather(ids.pool)
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(ids.length)
    length = total[ends] - total[ends - ids.length]
    same = length == raw.length
    if same.all():
        if np.array_equal(pool, raw.pool):
            return same
        differs = np.concatenate([[0], np.cumsum(pool != raw.pool)])
        return differs[raw.start + raw.length] == differs[raw.start]
    keep = np.flatnonzero(same)
    start = total[ends - ids.length][keep]
    own = Runs.of(pool, raw.length[keep], start)
    there = subset(raw, keep)
    differs = np.concatenate([[0], np.cumsum(own.gather(np.arange(len(keep)))[0] != there.pool)])
    same[keep] = differs[there.start + there.length] == differs[there.start]
    return same


class Texts:
    """A slice of texts with the links of their units.

    ``rows`` are the texts that have tokens, ``codes`` the places of their units in
    ``links`` one after the other, from ``starts[i]`` to ``starts[i + 1]`` for the
    i-th of ``rows``.
    """

    def __init__(self, pair: Pair, texts: pa.Array):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, Links]] = []
        left = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if pair.cuts and len(left):
            left = self._keep(pair, left, *self._spelled(texts.take(pa.array(left))))
        if pair.cuts and len(left):
            left = self._keep(pair, left, *coded([CUT.split(" " + t) for t in texts.take(pa.array(left)).to_pylist()]))
        if len(left):
            self._keep(pair, left, *coded([[" " + t] for t in texts.take(pa.array(left)).to_pylist()]))

    @staticmethod
    def _spelled(texts: pa.Array):
        """Cut at all spaces and line ends in Arrow; a text with more white space between words is not taken in."""
        return spelled(pc.replace_substring(texts, "\n", " \n"))

    def _keep(self, pair: Pair, rows: np.ndarray, units: list, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Take in the texts all of whose units are good; the others are returned."""
        ids = pair.encoded(units)
        good = np.fromiter((x is not None for x in ids), bool, len(ids))
        n = np.diff(starts)
        ok = sums(good[codes], starts) == n
        if ok.any():
            place = np.cumsum(good) - 1
            own = codes if ok.all() else codes[np.repeat(ok, n)]
            links = Links(pair, ids if good.all() else [x for x in ids if x is not None])
            self.parts.append((rows[ok], place[own], np.concatenate([[0], np.cumsum(n[ok])]), links))
        return rows[~ok]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def coded(lists: list[list[str]]):
    """(distinct strings, code of each in order, starts of the lists)"""
    place: dict[str, int] = {}
    codes = np.array([place.setdefault(s, len(place)) for x in lists for s in x], np.int64)
    return list(place), codes, np.concatenate([[0], np.cumsum([len(x) for x in lists])])
