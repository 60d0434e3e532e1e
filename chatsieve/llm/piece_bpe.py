"""SentencePiece BPE: exact encoding by backtracking, and decoding.

The encoder works on merge-type vocabularies.  A token sequence is the
merge result if and only if every two neighbours are compatible, that is if
merging their joined text gives the two back.  So the encoder takes the
longest token that starts at the current place (Aho-Corasick), checks it
against the token before, falls back to shorter prefixes, and steps back one
token where none fits; a bitfield remembers places from which no way leads
on, so none is tried twice.  Compatibility is decided by re-merging the pair
and remembered.

A text is cut first at every place that no piece can span (after the white
space mark's words, between characters that are adjacent in no piece), so
the encoder sees short strings, most of which a bounded table already knows.
Runs of two or more white-space marks have pieces of equal score, for which
neighbour compatibility does not determine the merge order; strings with
such a run are merged directly.

The model file is a parameter; each Python worker builds its tables once.
Work is a ``mapInPandas`` over the scan: no shuffle, bounded tables, and a
lost executor only repeats its splits.

Defined results: null and empty texts have no ids and decode to an empty
text; repeated rows are encoded alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from chatsieve.llm.common import id_and_text, ship_package, sole_tables

MARK = "▁"
KNOWN_STRINGS = 250_000  # entries in each of a worker's two tables
KNOWN_PAIRS = 1_000_000


class PieceModel:
    """Tables of one model file: pieces, scores, byte ids, and which pieces merges can reach."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i] and not sp.is_unused(i)}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.adjacent = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
                         else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode()
                         for i, p in enumerate(self.pieces)]
        self.reached = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p in self.reached:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), None)
                        for p in self.reached}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, s: str) -> list[str]:
        """Plain merging: best score first, leftmost first among equals."""
        sym = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (both := sym[i] + sym[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not sym[i] or not sym[j] or right[i] != j or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in sym if x]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) < KNOWN_PAIRS:
                self.pairs[a, b] = known
        return known

    def backtrack(self, s: str) -> list[str]:
        """Merge result of ``s``, all of whose characters are pieces."""
        def first(at: int) -> str | None:
            return next(self.longest.iter_long(s, at))[1] if at < len(s) else None

        open_ = bytearray(b"\x01") * (len(s) + 1)  # places not known to fail
        out: list[str] = []
        at, token = 0, first(0)
        while token is not None:
            before = out[-1] if out else None
            while True:
                end = at + len(token)
                if open_[end] and (before is None or self.compatible(before, token)):
                    out.append(token)
                    at, token = end, first(end)
                    break
                if (less := self.shorter[token]) is not None:
                    token = less
                    continue
                open_[at] = 0
                out.pop()  # the first token always has a way on, so there is one
                at -= len(before)
                token = before
                break
        return out

    def ids(self, s: str) -> list[int]:
        """Ids of a string that no piece leaves; unknown characters become bytes."""
        if len(s) == 1 and s not in self.id:
            raw = s.encode()
            return [self.byte[b] for b in raw] if self.byte else [self.unknown]
        return [self.id[p] for p in (self.merge(s) if MARK * 2 in s else self.backtrack(s))]

    def cut(self, s: str) -> list[str]:
        """Parts of ``s`` between which no merge can happen."""
        adjacent, out, at = self.adjacent, [], 0
        for i in range(1, len(s)):
            if s[i - 1:i + 1] not in adjacent:
                out.append(s[at:i])
                at = i
        out.append(s[at:])
        return out

    def decode(self, ids) -> str:
        """Text of ``ids``: the white-space mark put in front is taken off, bad bytes become U+FFFD."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        lead = next((i for i in ids if self.bytes_of[i]), None)
        if lead is not None and self.pieces[lead].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


class _Parts(dict):
    """Part -> comma-joined ids and their number; bounded."""

    def __init__(self, m: PieceModel):
        self.m = m

    def __missing__(self, s: str) -> str:
        out = ",".join(map(str, self.m.ids(s)))
        if len(self) < KNOWN_STRINGS and len(s) < 40:
            self[s] = out
        return out


class _Units(dict):
    """White-space unit -> comma-joined ids; bounded."""

    def __init__(self, m: PieceModel):
        self.m, self.parts = m, _Parts(m)

    def __missing__(self, unit: str) -> str:
        out = ",".join([self.parts[p] for p in self.m.cut(MARK + unit)])
        if len(self) < KNOWN_STRINGS and len(unit) < 40:
            self[unit] = out
        return out


@lru_cache(maxsize=2)
def _units(path: str) -> _Units:
    return _Units(model(path))


_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode_text(text: str, path: str) -> str:
    """Comma-joined decimal ids of ``text``."""
    if not text:
        return ""
    units = _units(path)
    if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
        return ",".join(map(units.__getitem__, text.split(" ")))
    parts, m = units.parts, units.m
    out = []
    for run in _RUNS.findall(MARK + text.replace(" ", MARK)):
        if run[0] == MARK and run[1:2] != MARK:
            out.append(units[run[1:]])
        else:
            out.extend([parts[p] for p in m.cut(run)])
    return ",".join(out)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``ids`` (array of int)."""
    df = id_and_text(docs, id_col, text_col)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(model, _units)
        for b in batches:
            ids = [[int(x) for x in s.split(",")] if s else [] for s in (encode_text(t, model_path) for t in b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids})

    return df.mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and ``text``."""
    df = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(model, _units)
        m = model(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": ["" if x is None else m.decode(x) for x in b["ids"]]})

    return df.mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    df = id_and_text(docs, id_col, text_col)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(model, _units)
        m = model(model_path)
        for b in batches:
            n, enc, dec = [], [], []
            for t in b["text"]:
                ids = encode_text(t, model_path)
                listed = list(map(int, ids.split(","))) if ids else []
                n.append(len(listed))
                enc.append(hashlib.sha256(ids.encode()).hexdigest())
                dec.append(hashlib.sha256(m.decode(listed).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": enc, "decoded_sha256": dec})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
