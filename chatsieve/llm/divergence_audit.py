"""Source divergence audit: how the word use of each source differs from its language and from its other sources.

One pass over the texts builds block postings in memory: for each (lang, source,
term) of a block its occurrences and its documents.  When a block is full it
leaves the task as a run in term order.  Runs are dealt by a hash of (lang,
term) and merged in order in each shard (Spark's external sort merges the
sorted runs with a heap), so the rows of a term stream by and become its
frequencies; terms in fewer than ``min_docs`` documents of their language stop
here.

The sum over all kept terms for two sources is taken in parts.  A term that
neither has adds a constant, one that a single one has depends on its count
there alone (so a histogram of counts gives it), and only terms that both have
are walked through: a stream over the term-sorted frequencies adds their
corrections.

With p = 1 + floor(10^9 * (count + 1) / (N + V)), a value is floor((p - q)^2 / q).
All numbers are exact integers: 10^9 * (count + 1) is divided three digits at a
time, so N + V may reach 9 * 10^15.

Defined results: null text, lang and source count as empty; a group without
terms is a row of every other group's pairs and gets its own; very long texts
are read whole (a block holds at least one document); repeated rows count as
documents each; ties in value are ranked by item in UTF-8 order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import ship_package, write_and_read
from chatsieve.llm.strings import slices, summed

MIN_DOCS = 3
TOP = 200
STEPS = (1000, 1000, 1000)  # 10^9, in factors by which a rest is carried on
BLOCK_ENTRIES = 1_000_000  # (lang, source, term) entries of a block's slices, about 100 MB with their terms
RUN_ROWS = 50_000  # rows of a run in one Arrow batch
BLOCK_PAIRS = 200_000  # (lang, source, source) sums that a task holds before it lets them go
# Letters are lower-cased (A-Z only), bytes beyond ASCII stay, all others separate terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DOC = 1 << 44  # an entry holds its documents above this bit and its occurrences below
POSTING = "lang string, source string, term binary, n long, n_docs long"


def terms(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct terms, code of each occurrence, text of each occurrence) of a binary array without nulls.

    Terms are runs of ASCII letters and characters beyond ASCII; A-Z in lower case.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = data[int(ends[0]):int(ends[-1])].to_pybytes().translate(FOLD) if data and len(texts) else b""
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(folded)))
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if "" in names:  # white space at the ends of a text
        there = codes != names.index("")
        codes, text = codes[there], text[there]
    return names, codes.astype(np.int64), text


class Block:
    """Postings of some documents in memory: (group, term) entries with their documents and occurrences."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # group, term, documents and occurrences
        self.size = 0

    def add(self, b: pa.RecordBatch) -> None:
        names, codes, text = terms(b.column(2))
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in
                          zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        width = max(len(names), 1)
        held = np.sort(text * width + codes)  # by text and term: a run is a term's occurrences in a text
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(held)))
        keys, packed = summed(group[held[first] // width] * width + held[first] % width, DOC + n)
        place = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in names), np.int64, len(names))
        self.entries.append((keys // width, place[keys % width], packed))
        self.size += len(keys)

    def run(self) -> Iterator[pa.RecordBatch]:
        """The entries in (term, lang, source) order; the block is empty then."""
        if not self.size:
            return
        names = pa.array(list(self.terms), pa.string())
        by_name = pc.sort_indices(names).to_numpy()
        term_rank = np.empty(len(names), np.int64)
        term_rank[by_name] = np.arange(len(names))
        groups = sorted(self.groups)
        group_rank = np.empty(len(groups), np.int64)
        group_rank[[self.groups[g] for g in groups]] = np.arange(len(groups))
        group, term, packed = (np.concatenate(x) for x in zip(*self.entries))
        keys, packed = summed(term_rank[term] * len(groups) + group_rank[group], packed)
        lang, source = (pa.array(x, pa.string()) for x in zip(*groups))
        self.__init__()
        for at in range(0, len(keys), RUN_ROWS):
            k, x = keys[at:at + RUN_ROWS], packed[at:at + RUN_ROWS]
            g = pa.array(k % len(groups))
            yield pa.RecordBatch.from_arrays(
                [lang.take(g), source.take(g), names.take(pa.array(by_name[k // len(groups)])).cast(pa.binary()),
                 pa.array(x % DOC), pa.array(x // DOC)], names=["lang", "source", "term", "n", "n_docs"])


def postings(docs: DataFrame) -> DataFrame:
    """The runs of all blocks of (lang, source, text): lang, source, term, n (occurrences), n_docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for b in slices(batch, 2):
                block.add(b)
                if block.size > BLOCK_ENTRIES:
                    yield from block.run()
        yield from block.run()

    ship_package(docs.sparkSession)
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, POSTING)


def changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in some of ``columns``."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in columns:
        code = rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
        out[1:] |= code[1:] != code[:-1]
    return out


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of term-sorted rows as tables that end with a term, and the place of each term's first row."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b] if left is None else [left, b]).combine_chunks()
        first = np.flatnonzero(changes(rows, ["lang", "term"]))
        left = rows.slice(int(first[-1])).to_batches()[0]  # the last term may go on
        if len(first) > 1:
            yield rows.slice(0, int(first[-1])), first[:-1]
    if left is not None:
        yield pa.Table.from_batches([left]), np.array([0])


def frequencies(runs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each kept term and source that has it: lang, source, term, n, lang_n, opens (first row of its term)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in whole_terms(batches):
            size = np.diff(np.append(first, rows.num_rows))
            n, n_docs = rows["n"].to_numpy(), rows["n_docs"].to_numpy()
            kept = np.repeat(np.add.reduceat(n_docs, first) >= min_docs, size)
            lang_n = np.repeat(np.add.reduceat(n, first), size)
            opens = np.zeros(len(n), np.int32)
            opens[first] = 1
            # Rows of one source come from different blocks: they become one.
            own = np.flatnonzero(changes(rows, ["lang", "term", "source"]))
            own, n = own[kept[own]], np.add.reduceat(n, own)[kept[own]]
            yield from pa.table({"lang": rows["lang"].take(own), "source": rows["source"].take(own), "term": rows["term"].take(own),
                                 "n": n, "lang_n": lang_n[own], "opens": opens[own]}).to_batches()

    # The term first: it is what tells rows apart early in a comparison.
    return (runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
            .mapInArrow(run, "lang string, source string, term binary, n long, lang_n long, opens int"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total)."""
    quotient, rest = F.lit(0).cast("long"), n.cast("long") + 1
    for step in STEPS:
        rest = rest * step
        quotient = quotient * step + F.call_function("div", rest, total)
        rest = rest % total
    return quotient + 1


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def totals(docs: DataFrame, freq: DataFrame) -> DataFrame:
    """lang, source, n_kept (V), total and lang_total (N + V; 1 where that is 0) of every occurring group."""
    groups = docs.select("lang", "source").distinct()
    counts = freq.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("opens").cast("long").alias("v"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("n_kept"))
    none = F.lit(0).cast("long")
    both = groups.join(counts.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    return both.select("lang", "source", "n_kept", F.greatest(F.col("n") + F.col("n_kept"), none + 1).alias("total"),
                       F.greatest(F.col("lang_n") + F.col("n_kept"), none + 1).alias("lang_total"))


def joint_corrections(freq: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, part_sum: over the terms that both sources have, what the pair adds to what each adds alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows, first in whole_terms(batches):
            lang, source = rows["lang"].combine_chunks().dictionary_encode(), rows["source"].combine_chunks().dictionary_encode()
            names = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            l, s = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
            p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
            size = np.diff(np.append(first, rows.num_rows))
            last = np.repeat(first + size, size)  # a row's partners are those before its term's end
            i = np.arange(rows.num_rows)
            for lag in range(1, int(size.max())):
                i = i[i + lag < last[i]]
                for a, b in ((i, i + lag), (i + lag, i)):
                    add = (whole_value(p[a], p[b]) - whole_value(p[a], p0[b]) - whole_value(p0[a], p[b])
                           + whole_value(p0[a], p0[b]))
                    keys, sums = summed((l[a] * len(names[1]) + s[a]) * len(names[1]) + s[b], add)
                    for k, x in zip(keys.tolist(), sums.tolist()):
                        k, t = divmod(k, len(names[1]))
                        k, u = divmod(k, len(names[1]))
                        held[names[0][k], names[1][u], names[1][t]] += x
            if len(held) > BLOCK_PAIRS:
                yield sums_out(held)
                held.clear()
        if held:
            yield sums_out(held)

    own = freq.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"),
        share(F.lit(0), F.col("total")).alias("p0"))
    ship_package(freq.sparkSession)
    return (own.repartition("lang", "term").sortWithinPartitions("term", "lang")
            .mapInArrow(run, "lang string, source string, item string, part_sum long"))


def whole_value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def sums_out(held: Counter) -> pa.RecordBatch:
    lang, source, item = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(item), pa.array(list(held.values()), pa.int64())],
                                      names=["lang", "source", "item", "part_sum"])


def pair_values(freq: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value."""
    one, other = ([F.col(c).alias(f"{c}{x}") if c != "lang" else F.col(c) for c in ("lang", "source", "total", "n_kept")]
                  for x in ("_s", "_t"))
    pairs = groups.select(*one).join(groups.select(*other).drop("n_kept_t"), "lang").where("source_s <> source_t").select(
        "lang", F.col("source_s").alias("source"), F.col("source_t").alias("item"), F.col("n_kept_s").alias("n_kept"),
        "total_s", "total_t", share(F.lit(0), F.col("total_s")).alias("s0"), share(F.lit(0), F.col("total_t")).alias("t0"))
    constant = pairs.select("lang", "source", "item", (F.col("n_kept") * value(F.col("s0"), F.col("t0"))).alias("part_sum"))
    # How many terms of a source have a count: all that the terms of a single source depend on.
    histogram = freq.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    base = value(F.col("s0"), F.col("t0"))
    alone_s = pairs.join(histogram, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (value(share(F.col("n"), F.col("total_s")), F.col("t0")) - base)).alias("part_sum"))
    alone_t = pairs.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (value(F.col("s0"), share(F.col("n"), F.col("total_t"))) - base)).alias("part_sum"))
    parts = constant.unionByName(alone_s).unionByName(alone_t).unionByName(joint_corrections(freq, groups))
    return parts.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("value"))


def term_values(freq: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has more of than its lang), value."""
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    return (freq.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"),
                                                          p.alias("p"), q.alias("q"))
            .where("p > q").select("lang", "source", "item", value(F.col("p"), F.col("q")).alias("value")))


def ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; ``term`` rows to rank ``top``."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                        for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    freq = write_and_read(frequencies(postings(own), min_docs), "term-frequencies")
    groups = write_and_read(totals(own, freq), "group-totals")
    return ranked(pair_values(freq, groups), "pair").unionByName(
        ranked(term_values(freq, groups), "term").where(F.col("rank") <= top))
