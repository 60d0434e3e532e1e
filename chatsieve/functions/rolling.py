"""Rolling hashes of character n-grams over Arrow batches.

One prefix array of 8 bytes a character gives the hash of every n-gram of
every length by one subtraction and one multiplication, so no n-gram string is
ever built.  Hashes are polynomials modulo 2^64 over code points, mixed at the
end; they only propose, and whoever uses them compares the characters.

The functions run in Python workers and are shipped with the job by value, so
the workers need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
PORTION = 1 << 19  # characters hashed at a time (a longer text is a portion of its own)
COMPARED = 1 << 20  # characters compared at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads close values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def portions(texts: list):
    """Places (from, to) of texts that make up about ``PORTION`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > PORTION:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


class Codes:
    """Code points of some texts, one after the other, and their prefix hashes."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        self.codes = np.frombuffer(b"".join(raw), "<u4")
        self.ends = np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.prefix = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * powers(BASE, len(self.codes)), out=self.prefix[1:])
        self.back = powers(INVERSE, len(self.codes))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n-gram at every place (those that cross into the next text mean nothing)."""
        if len(self.codes) < n:
            return np.empty(0, np.uint64)
        return mix((self.prefix[n:] - self.prefix[:-n]) * self.back[:len(self.codes) - n + 1] + np.uint64(n))

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> bool:
        """Whether the n-grams at places ``a`` are those at ``b``, character by character."""
        step = max(1, COMPARED // n)
        own = np.arange(n)
        return all(np.array_equal(self.codes[a[i:i + step, None] + own], self.codes[b[i:i + step, None] + own])
                   for i in range(0, len(a), step))


def distinct_grams(codes: Codes, hashes: np.ndarray, start: int, end: int, n: int) -> int:
    """Number of different n-grams of the text from ``start`` to ``end``, exactly."""
    own = hashes[start:end - n + 1]
    ordered = np.sort(own)
    distinct = 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1]))
    if distinct == len(own):
        return distinct  # equal n-grams have equal hashes
    order = np.argsort(own, kind="stable") + start
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    if codes.same(order[again], order[again + 1], n):
        return distinct
    text = codes.codes[start:end].tobytes()  # two n-grams share a hash
    return len({text[4 * i:4 * (i + n)] for i in range(len(own))})


def repeated_share(texts: list, n: int) -> list[float]:
    """``1 - different / all`` n-grams of each text; 0 for null and shorter ones."""
    out: list[float] = []
    for i, j in portions(texts):
        codes = Codes([t or "" for t in texts[i:j]])
        hashes = codes.grams(n)
        out += [1.0 - distinct_grams(codes, hashes, s, e, n) / (e - s - n + 1) if e - s >= n else 0.0
                for s, e in zip(codes.starts.tolist(), codes.ends.tolist())]
    return out


def ngram_repetition(text: Column, n: int) -> Column:
    """Share of repeated character n-grams of a text column, in Arrow batches."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(repeated_share(texts.tolist(), n), dtype="float64")

    return run(text)


def repetition_column(batches, n: int, out: str):
    """Batches whose last column is a text: all others, and in its place the text's share of repeated n-grams."""
    for b in batches:
        share = pa.array(repeated_share(b.column(b.num_columns - 1).to_pylist(), n), pa.float64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], share], names=[*b.schema.names[:-1], out])


# -- winnowing ---------------------------------------------------------------

def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = op(x[:-step], x[step:]) if step < len(x) else x[:0], done + step
    return x


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some ``window`` hashes in a row (all of several smallest)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    low = sliding(np.minimum, hashes, window)
    ends = np.zeros(window - 1, np.uint64)
    best = sliding(np.maximum, np.concatenate([ends, low, ends]), window)  # best[i]: largest minimum of windows over i
    return np.flatnonzero(best == hashes)


def tagged(hashes: np.ndarray, tag: int) -> np.ndarray:
    """Hashes of one kind of fingerprint, apart from other kinds'."""
    return mix(hashes ^ np.uint64((tag * BASE) & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)


def item_fingerprints(batches, k: int, window: int):
    """(id, place, h) of hold-out items: winnowed k-grams of long items, all k-grams of shorter ones, and
    those shorter than k as one gram."""
    for b in batches:
        ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
        rows: list[tuple[int, int, int]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            own = Codes([t])
            n = len(own.codes)
            grams = own.grams(min(k, n))
            at = winnowed(grams, window) if n >= k + window - 1 else np.arange(len(grams))
            tag = 0 if n >= k + window - 1 else k if n >= k else n
            rows += [(i, p, h) for p, h in zip(at.tolist(), tagged(grams[at], tag).tolist())]
        at, place, h = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(place, pa.int64()), pa.array(h, pa.int64())],
                                         names=["__iid", "__ipos", "__h"])


def row_fingerprints(batches, k: int, window: int, lengths: list[int], wanted: bytes):
    """(id, place, h) of the fingerprints that may be an item's: ``wanted`` is a bitmap over hashes.

    ``lengths`` has 0 where long items occur, and the gram lengths of the shorter ones.
    """
    bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").view(bool)
    mask = np.int64(len(bits) - 1)
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for i, j in portions(texts):
            codes = Codes(texts[i:j])
            found = []
            for tag in lengths:
                n = tag or k
                grams = codes.grams(n)
                at = np.arange(len(grams)) if tag else winnowed(grams, window)
                h = tagged(grams[at], tag)
                keep = bits[h & mask]
                at, h = at[keep], h[keep]
                row = np.searchsorted(codes.ends, at, "right")
                inside = at + n <= codes.ends[row]
                found.append((row[inside] + i, (at - codes.starts[row])[inside], h[inside]))
            row, place, h = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(place), pa.array(h)],
                                             names=["__rid", "__rpos", "__h"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
