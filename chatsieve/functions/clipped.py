"""Clipped character n-gram matches of pairs of texts over Arrow batches.

The matches of order ``n`` are the sum, over the n-grams of a key, of the
smaller of both sides' counts.  Rows of a key come one after the other.  About
``PORTION`` characters are counted at a time: n-grams are numbered through the
numbers of their prefixes (an (n+1)-gram is a numbered n-gram and a character),
so equal numbers mean equal n-grams of one key, and no n-gram string is built.
Only places whose n-gram is on both sides can hold a longer match.

A key of more than ``2 * PORTION`` characters is cut between two rows; for it
each portion gives its n-grams and their counts, which Spark adds up.

The functions run in Python workers and are shipped with the job by value, so
the workers need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

PORTION = 1 << 19  # characters counted at a time (a longer row is a portion of its own)
ROW = 16  # what a row counts besides its characters
CODE_BITS = 21  # of a code point


def portions(batches, size: int):
    """Rows (key columns, first row of its key or not, two texts) by about ``size`` characters, and whether
    the last key goes on; keys of up to ``size`` characters stay whole."""
    held, have = [], 0
    for b in batches:
        new = b.column(b.num_columns - 3).to_pylist()
        sizes = pc.add(pc.utf8_length(b.column(b.num_columns - 2)), pc.utf8_length(b.column(b.num_columns - 1))).to_pylist()
        at = 0
        for i, (first, n) in enumerate(zip(new, sizes)):
            if have >= size and (first or have >= 2 * size):
                yield pa.Table.from_batches([*held, b.slice(at, i - at)]), not first
                held, have, at = [], 0, i
            have += n + ROW
        if at < len(new):
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held), False


def count_matches(hyps: list[str], refs: list[str], key: np.ndarray, cut: np.ndarray, max_n: int):
    """Matches by order and key, 0 for the keys that are ``cut``; of those (key, n, n-gram, counts) instead."""
    texts = hyps + refs
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from a place to its text's end
    refs_from = int(lengths[:len(hyps)].sum())
    at = np.arange(len(codes))
    number, key_of = np.repeat(np.concatenate([key, key]), lengths), np.arange(len(cut))
    matches, counts = np.zeros((max_n, len(cut)), np.int64), []
    for n in range(1, max_n + 1):
        fits = left[at] >= n
        at, number = at[fits], number[fits]
        grams, number = np.unique(number << CODE_BITS | codes[at + n - 1], return_inverse=True)
        key_of = key_of[grams >> CODE_BITS]
        in_hyp = np.bincount(number[at < refs_from], minlength=len(grams))
        in_ref = np.bincount(number[at >= refs_from], minlength=len(grams))
        both = np.minimum(in_hyp, in_ref)
        matches[n - 1] = np.bincount(key_of, both, len(cut))
        parts = np.flatnonzero(cut[key_of])
        if len(parts):
            place = np.empty(len(grams), np.int64)
            place[number] = at
            text = codes[place[parts, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
            counts.append((key_of[parts], n, [text[i:i + n] for i in range(0, len(text), n)], in_hyp[parts], in_ref[parts]))
        on = ((both > 0) | cut[key_of])[number]
        at, number = at[on], number[on]
    matches[:, cut] = 0
    return matches, counts


def clipped_matches(batches, n_by: int, max_n: int, names: list[str], size: int = PORTION):
    """A row a key: its first ``n_by`` columns and sums over its rows (matches and denominators by order,
    lengths, rows); a row an n-gram of a cut key: all key columns, order, n-gram and both counts."""
    for rows, goes_on in portions(batches, size):
        *keys, new, hyps, refs = rows.columns
        new, hyps, refs = np.array(new.to_pylist(), bool), hyps.to_pylist(), refs.to_pylist()
        key = np.cumsum(new) - int(new[0])
        cut = np.zeros(key[-1] + 1, bool)
        cut[0] |= not new[0]
        cut[-1] |= goes_on
        matches, counts = count_matches(hyps, refs, key, cut, max_n)
        sums = [np.array([len(t) for t in side], np.int64) for side in (hyps, refs)] + [np.ones(len(key), np.int64)]
        sums = [np.maximum(1, sums[0] - n + 1) for n in range(1, max_n + 1)] + sums
        sums = [*matches, *[np.bincount(key, s, len(cut)).astype(np.int64) for s in sums]]
        first = np.searchsorted(key, np.arange(len(cut)))

        def out(of, by, columns):
            own = [c.take(pa.array(first[of])) if i < by else pa.nulls(len(of), c.type) for i, c in enumerate(keys)]
            return pa.Table.from_arrays([*own, *map(pa.array, columns)], names=names).combine_chunks().to_batches()

        none = np.zeros(len(cut), np.int64)
        yield from out(np.arange(len(cut)), n_by, [pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.string()), none, none, *sums])
        for of, n, grams, in_hyp, in_ref in counts:
            yield from out(of, len(keys), [np.full(len(of), n, np.int32), pa.array(grams, pa.string()), in_hyp, in_ref,
                                           *[np.zeros(len(of), np.int64)] * len(sums)])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
