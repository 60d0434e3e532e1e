"""Exact Jaccard similarity join of word-shingle sets, by a prefix filter.

The dealt method (document pivots, Voronoi regions, triangle windows) was
exchanged: the Jaccard distance of unrelated texts is 1 to every document
pivot, so each boundary window would hold the whole corpus.

**Regions.**  Shingles have one global order: by how many texts are expected to
hold them, from the counts of their words (a table of fixed size), or found to
where these are more, then by hash.  So texts seldom share one of their first
members by chance, however many there are.  Let ``t`` be the number of members
of A that a set within the threshold may lack.  A goes to the regions of its first
``t + 1`` members; a set within the threshold shares one of them, so no pair
is lost.

**Recursive join.**  In each region one document is the pivot and every other
member is compared with it; members within the threshold are linked to it, and
pairs that are connected already need no comparison.  Regions that still hold
two components join all pairs across components, if they have at most
``SMALL`` members; larger ones are split by a second (third) pivot, the next
shared member, which lies among the first ``t + 2`` (``t + 3``).  What is
still large at the last depth joins all pairs across components too, so the
result is exact at any size.  (Splitting parts texts that share a passage; it
does not part texts that are all alike, which the region's pivot links first.)

**Comparison.**  Three exact bounds come first: sizes, positions of the shared
pivot, and the parities of how many members fall in each of about two slots a
member: the slots in which two sets differ are no more than the members that
only one of them has.  Sets of the survivors are computed again from their texts and
intersected.  Equal sets are one node throughout, found by a 128-bit digest, so
copies are never paired.

Everything is equi-joins and partial aggregation on narrow rows; AQE can split
hot regions and components.  Broadcast are, of fixed size, the list of frequent
shingles (at most 2^17), the word counts (2^18 bytes) and the bits of the wanted
texts (2^17 longs), by which texts that no pair needs are never shuffled.
Shingles are 62-bit hashes, members of fronts and regions keep 54 bits of them
beside their level, which only adds candidates.  Each table is deleted after
its last reader, and shuffle files go with the query that made them.

Defined results: null texts and texts without words are empty sets, linked
with nothing, and their component is their own id; rows equal in id and text
get the same result; rows that share an id but not a text are judged by their
texts; null ids never become a component id unless the component has no other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import delete_written, id_and_text, ship_package, sole_tables, write_and_read

SMALL = 4096
DEPTH = 3
FREQUENT = 1 << 17
SAMPLED, LEAST = 16, 4  # frequent is what this many texts of one in so many hold
WORD_BUCKETS = 1 << 18  # of the table of word counts
WANTED_LONGS = 1 << 17  # of the bits of the wanted texts
CODE_BITS, HASH_BITS = 62, 54  # of a shingle, and what a member keeps of them below its level
ONCE = 160  # the level of what one sampled text holds; it grows by 2 where the count doubles
KNOWN_WORDS = 300_000
ROWS = 500  # sets handed over at once


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _word_hash() -> _WordHash:
    return _WordHash()


def _word_ids(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    return np.fromiter(map(_word_hash().__getitem__, words), dtype=np.uint64, count=len(words))


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    code = np.full(len(ids) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        code = (code ^ ids[j:len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(2)).astype(np.int64)


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 62-bit codes of the n-word shingles (the whole text if it is shorter)."""
    ids = _word_ids(text)
    return np.unique(_codes(ids, min(n, len(ids)))) if len(ids) else np.empty(0, dtype=np.int64)


def shingle_levels(text: str, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the codes of ``shingle_set``, the level of the count that their words, if independent, lead to expect)."""
    ids = _word_ids(text)
    if not len(ids):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    k = min(n, len(ids))
    codes, first = np.unique(_codes(ids, k), return_index=True)
    ends = np.concatenate([[0], np.cumsum(words[ids & np.uint64(WORD_BUCKETS - 1)], dtype=np.int64)])
    return codes, np.clip(ONCE + ends[first + k] - ends[first] - (k - 1) * int(words[-1]), 0, 255)


def odd_slots(codes: np.ndarray) -> np.ndarray:
    """Bits, in longs: whether an odd number of members has each remainder by the number of slots.

    There are two slots a member or more, by powers of two from 64 on, so sets
    of similar sizes have as many slots or one of them twice as many.
    """
    slots = 64
    while slots < 2 * len(codes):
        slots *= 2
    count = np.bincount(codes & (slots - 1), minlength=slots)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _differing(one: str, two: str) -> Column:
    """Slots of odd count in one of two sets only; those of the set with more are folded first."""
    slots = F.least(F.size(one), F.size(two))

    def folded(c: str) -> Column:
        half = F.zip_with(F.slice(c, F.lit(1), slots), F.slice(c, slots + 1, slots), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > slots, half).otherwise(F.col(c))

    return F.aggregate(F.zip_with(folded(one), folded(two), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                       lambda total, x: total + x)


def _missing_allowed(n, num: int, den: int):
    """Members of a set of ``n`` that a set within the threshold may lack."""
    return n - -(-n * num // den)


def fronts(df: DataFrame, n: int, num: int, den: int, words: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, n, sig, front, odd): hash of the text, set size, digest, first members in the global order
    (the window and one for each further depth) and the slots of odd count.
    """
    spark = df.sparkSession
    ship_package(spark)
    tables = spark.sparkContext.broadcast((words, *frequent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(_word_hash)
        known, hot, hot_level = tables.value
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                b = whole.iloc[lo:lo + ROWS]
                size, sig, front, odd = [], [], [], []
                for text in b["text"]:
                    codes, level = shingle_levels(text, n, known)
                    sig.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                    size.append(len(codes))
                    if len(hot) and len(codes):
                        at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
                        level = np.where(hot[at] == codes, np.maximum(level, hot_level[at]), level)
                    window = _missing_allowed(len(codes), num, den) + 1
                    front.append(np.sort((level << HASH_BITS) | (codes >> (CODE_BITS - HASH_BITS)))[:window + DEPTH])
                    odd.append(odd_slots(codes))
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "key": b["key"].to_numpy(), "n": size, "sig": sig,
                                    "front": front, "odd": odd})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.withColumn("key", F.xxhash64("text")).mapInPandas(
        run, f"doc_id {kind}, key long, n long, sig binary, front array<long>, odd array<long>")


def sampled_texts(df: DataFrame) -> DataFrame:
    """The different texts of a sixteenth of all, by hash."""
    key = F.xxhash64("text")
    texts = df.select("text", key.alias("key")).where(F.pmod("key", F.lit(SAMPLED)) == 0).groupBy("key").agg(F.min("text").alias("text"))
    return write_and_read(texts.select("text"), "jaccard-sample")


def word_levels(sample: DataFrame) -> np.ndarray:
    """Twice the binary logarithm of how often the words of each bucket of hashes are found in ``sample``, and of their sum.

    A table of fixed size.  It only sets the order of the members, on which
    speed depends and the result does not.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(_word_hash)
        count = np.zeros(WORD_BUCKETS, dtype=np.int64)
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                ids = np.concatenate([_word_ids(t) for t in whole["text"].iloc[lo:lo + ROWS]])
                count += np.bincount((ids & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=WORD_BUCKETS)
        at = np.flatnonzero(count)
        yield pd.DataFrame({"at": at, "c": count[at]})

    found = sample.mapInPandas(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # WORD_BUCKETS rows at most
    count = np.zeros(WORD_BUCKETS + 1)
    count[found["at"].to_numpy(dtype=np.int64)] = found["c"].to_numpy()
    count[-1] = count.sum()
    return (2 * np.log2(1 + count)).astype(np.uint8)


def frequent_shingles(sample: DataFrame, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, levels) of shingles that clearly more texts of ``sample`` hold than their words lead to expect.

    At most ``FREQUENT``; the least count is the smallest that keeps the bound.
    They only set the order of the members, too.
    """
    held_words = sample.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_tables(_word_hash)
        known = held_words.value
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                codes, level = map(np.concatenate, zip(*[shingle_levels(t, n, known) for t in whole["text"].iloc[lo:lo + ROWS]]))
                codes, first, count = np.unique(codes, return_index=True, return_counts=True)
                yield pd.DataFrame({"s": codes, "c": count, "expected": level[first]})

    counts = sample.mapInPandas(run, "s long, c long, expected long").groupBy("s").agg(F.sum("c").alias("c"), F.max("expected").alias("expected"))
    counts = counts.where(F.col("c") >= LEAST).withColumn("level", ONCE + F.floor(2 * F.log2("c")))
    counts = write_and_read(counts.where(F.col("level") >= F.col("expected") + 2).select("s", "c", "level"), "jaccard-counts")
    # How many have each count, by size in bits first and then in 64 steps of the size that doesn't fit whole.
    bits = F.length(F.bin("c"))
    by_size = {r["k"]: r["n"] for r in counts.groupBy(bits.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size, held, least = 63, 0, LEAST
    while size and held + by_size.get(size, 0) <= FREQUENT:
        held, size = held + by_size.get(size, 0), size - 1
    if size:
        least, step = 1 << size, max(1, (1 << (size - 1)) // 64)
        steps = counts.where(bits == size).groupBy(F.floor(F.col("c") / step).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(steps, key=lambda r: -r["k"]):
            held += r["n"]
            if held > FREQUENT:
                break
            least = r["k"] * step
    out = counts.where(F.col("c") >= max(LEAST, least)).select("s", "level").toPandas().sort_values("s")
    delete_written(counts)
    return out["s"].to_numpy(dtype=np.int64), out["level"].to_numpy(dtype=np.int64)


def _needed(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Least intersection of two sets of these sizes within the threshold."""
    return F.ceil(F.lit(num) * (n1 + n2) / F.lit(num + den)).cast("long")


def _possible(n1, p1, q1, n2, p2, q2, num, den) -> Column:
    """Size and position bounds for two sets that share the member at 0-based places p1 and p2.

    Of the members before it only q1 and q2 are in some other set's window; the
    others are in no set that has the shared member in its window.
    """
    most = F.least(q1, q2) + F.least(n1 - p1, n2 - p2)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (most >= _needed(n1, n2, num, den))


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, for the nodes of ``links`` (a, b).

    Each step takes the smallest label of the neighbours and then the label's
    own label.  Labels are written at each step, so the plan of a step does not
    grow with the number of steps; those of the step before are deleted.
    """
    links = links.select("a", "b")
    edges = write_and_read(links.union(links.select("b", "a")).distinct(), "jaccard-edges")
    label = write_and_read(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                           .select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")), "jaccard-labels")
    while True:
        seen = label.select(F.col("node").alias("b"), "comp")
        near = edges.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        low = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = write_and_read(low.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"),
                                                           (F.col("old") != F.least("comp", "far")).alias("moved")), "jaccard-labels")
        delete_written(label)
        label = new
        if not label.where("moved").limit(1).count():
            delete_written(edges)
            return label.select("node", "comp")


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.docs, self.n, self.num, self.den = docs, n, num, den
        ship_package(docs.sparkSession)
        sample = sampled_texts(docs)
        known = word_levels(sample)
        frequent = frequent_shingles(sample, n, known)
        delete_written(sample)
        made = write_and_read(fronts(docs, n, num, den, known, frequent), "jaccard-fronts")
        classes = made.where("n > 0").groupBy("sig").agg(
            F.min("doc_id").alias("first_id"), F.min(F.xxhash64("doc_id", "key")).alias("at"), F.max("n").alias("n"),
            F.first("front").alias("front"), F.first("odd").alias("odd"))
        self.nodes = write_and_read(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
        self.rows = write_and_read(made.drop("front", "odd"), "jaccard-rows")
        delete_written(made)
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None

    def window(self, more: int = 1) -> Column:
        n = F.col("n")
        return (n - F.ceil(n * self.num / F.lit(self.den)) + more).cast("int")

    def regions(self) -> DataFrame:
        """(r, node, n, pos, q) of the regions with two members or more; ``q`` of the ``pos`` members before are shared."""
        placed = self.nodes.select("node", "n", F.posexplode(F.slice("front", F.lit(1), self.window())).alias("pos", "r"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1  # in a set's window only
        shared = self.shared(placed, rank)
        # A set has no partner where it lacks too much already.
        return shared.where((F.col("n") - F.col("pos") + F.col("q")) * self.den >= F.col("n") * self.num)

    def shared(self, placed: DataFrame, q: Column) -> DataFrame:
        count = placed.groupBy("r").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return write_and_read(placed.join(count.select("r"), "r").withColumn("q", q), "jaccard-regions")

    def live(self, members: DataFrame) -> DataFrame:
        """Members of regions that still hold two components, with ``comp`` and the region's size ``c``."""
        if self.comp is None:
            members = members.withColumn("comp", F.col("node"))
        else:
            members = (members.join(self.comp, "node", "left")
                       .withColumn("comp", F.coalesce("comp", "node")))
        open_ = members.groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"),
                                         F.min(F.struct(F.col("pos") - F.col("q"), "node"))["node"].alias("pivot")
                                         ).where("low != high")
        return write_and_read(members.join(open_.select("r", "c", "pivot"), "r"), "jaccard-live")

    def with_pivots(self, live: DataFrame) -> DataFrame:
        """Pairs (a, b) of each region's pivot document with the other members."""
        lead = live.where("node = pivot").select("r", F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("q").alias("pq"),
                                                 F.col("comp").alias("pc"))
        return (live.join(lead, "r").where("node != pivot and comp != pc")
                .where(_possible(*(F.col(c) for c in ("n", "pos", "q", "pn", "pp", "pq")), self.num, self.den))
                .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())

    def across(self, live: DataFrame) -> DataFrame:
        """All pairs of different components in each region that the bounds allow."""
        x = live.select("r", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("pos").alias("p1"),
                        F.col("q").alias("q1"), F.col("comp").alias("c1"))
        y = live.select("r", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("p2"),
                        F.col("q").alias("q2"), F.col("comp").alias("c2"))
        on = (x["r"] == y["r"]) & (x["a"] < y["b"]) & (x["c1"] != y["c2"]) & _possible(
            x["n1"], x["p1"], x["q1"], y["n2"], y["p2"], y["q2"], self.num, self.den)
        return x.join(y, on).select("a", "b").distinct()

    def split(self, live: DataFrame, depth: int) -> DataFrame:
        """Large regions by the next shared member: (r, node, n, pos)."""
        far = live.join(self.nodes.select("node", "front"), "node")
        nxt = F.slice("front", F.col("pos") + 2, F.greatest(self.window(depth) - F.col("pos") - 1, F.lit(0)))
        far = far.select("r", "node", "n", "pos", "q", F.posexplode(nxt).alias("k", "s"))
        return self.shared(far.select(F.xxhash64("r", "s").alias("r"), "node", "n", (F.col("pos") + 1 + F.col("k")).alias("pos"),
                                      (F.col("q") + 1 + F.col("k")).alias("near")), F.col("near")).drop("near")

    def verify(self, pairs: DataFrame) -> None:
        """Compare the new pairs among ``pairs`` and add those within the threshold to the links."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = write_and_read(pairs, "jaccard-pairs")
        if not pairs.limit(1).count():
            delete_written(pairs)
            return
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        odd = self.nodes.select("node", "n", "odd")
        one = odd.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("odd").alias("o1"))
        two = odd.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("odd").alias("o2"))
        need = _needed(F.col("n1"), F.col("n2"), self.num, self.den)
        near = (pairs.join(two, "b").join(one, "a").where(_differing("o1", "o2") <= F.col("n1") + F.col("n2") - 2 * need)
                .select("a", "b", "n1", "n2"))
        near = write_and_read(near, "jaccard-near")
        sets = self.sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        both = (near.join(sets.select(F.col("node").alias("b"), F.col("codes").alias("s2")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("codes").alias("s1")), "a"))
        found = write_and_read(both.where(F.size(F.array_intersect("s1", "s2")) >= need).select("a", "b"), "jaccard-links")
        delete_written(near)
        delete_written(sets)
        self.links = found if self.links is None else self.links.unionByName(found)
        if found.limit(1).count():
            before, self.comp = self.comp, components(self.links)
            if before is not None:
                delete_written(before)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, codes): the whole sets of the wanted nodes, from the text of one row of each."""
        n = self.n
        own = write_and_read(self.nodes.select("node", "sig", "at").join(wanted, "node"), "jaccard-wanted")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sole_tables(_word_hash)
            for whole in batches:
                for lo in range(0, len(whole), ROWS):
                    codes = [shingle_set(t, n) for t in whole["text"].iloc[lo:lo + ROWS]]
                    yield pd.DataFrame({"sig": [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in codes],
                                        "codes": codes})

        def bit(at: str) -> tuple[Column, Column]:
            return F.pmod(at, F.lit(WANTED_LONGS)).alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({at}, 58) as int))").alias("bit")

        bits = own.select(*bit("at")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))  # WANTED_LONGS rows at most
        texts = self.docs.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("at")).select("text", "at", *bit("at"))
        texts = (texts.join(F.broadcast(bits), "slot").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
                 .join(own.select("at"), "at", "left_semi"))
        made = texts.select("text").mapInPandas(run, "sig binary, codes array<long>")
        made = write_and_read(made.join(own.select("node", "sig"), "sig").select("node", "codes")
                              .dropDuplicates(["node"]), "jaccard-sets")
        delete_written(own)
        return made

    def run(self) -> None:
        """Find all links, then delete what only this search reads."""
        self.search()
        if self.tested is not None:
            delete_written(self.tested)
        if self.links is not None:
            delete_written(self.links)
        nodes, self.nodes = self.nodes, write_and_read(self.nodes.select("sig", "node", "first_id"), "jaccard-names")
        delete_written(nodes)

    def search(self) -> None:
        members = self.regions()
        for depth in range(2, DEPTH + 2):
            live = self.live(members)
            if not live.limit(1).count():
                break
            self.verify(self.with_pivots(live))
            delete_written(live)
            live = self.live(members)
            delete_written(members)
            last = depth > DEPTH
            self.verify(self.across(live if last else live.where(F.col("c") <= SMALL)))
            large = live.where(F.col("c") > SMALL)
            if last or not large.limit(1).count():
                delete_written(live)
                return
            members = self.split(large, depth)
            delete_written(live)
        delete_written(live)
        delete_written(members)

    def named(self) -> DataFrame:
        """(sig, first_id, comp) of each set."""
        nodes = self.nodes.select("sig", "node", "first_id")
        if self.comp is None:
            return nodes.withColumnRenamed("node", "comp")
        return nodes.join(self.comp, "node", "left").select("sig", "first_id", F.coalesce("comp", "node").alias("comp"))

    def result(self) -> DataFrame:
        named = self.named()
        low = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        named = named.join(low, "comp")
        return (self.rows.select("doc_id", "n", "sig").join(named.select("sig", "component_id"), "sig", "left")
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))

    def redundant(self) -> DataFrame:
        """(doc_id, key) of the rows that do not stand for their component: all but the one with the smallest id
        and, among rows of that id, the smallest hash of its text."""
        rows = self.rows.where("n > 0 and doc_id is not null").join(self.named().select("sig", "comp"), "sig").select(
            "comp", F.struct("doc_id", "key").alias("row"))
        best = rows.groupBy("comp").agg(F.min("row").alias("best"))
        return rows.join(best, "comp").where("row != best").select("row.doc_id", "row.key").distinct()


def joined_sets(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> _Join:
    if not 0 < num <= den or num * (DEPTH + 1) < den * DEPTH:
        # Two different sets within the threshold share num / (den - num) members at
        # least, and DEPTH of them make the pivots of a region.
        raise ValueError("the threshold must be at most 1 and at least DEPTH / (DEPTH + 1)")
    join = _Join(id_and_text(docs, id_col, text_col), words, num, den)
    join.run()
    return join


def near_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when ``den * |intersection| >= num * |union|`` of their
    sets of ``words``-word shingles; a component takes its smallest id.
    """
    return joined_sets(docs, words, num, den, id_col, text_col).result()


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns.

    Of the rows with an id, that of the smallest id stays, by its text's hash
    where several have that id; rows with null ids stay too.  Rows are told apart
    by id and text, so a row that only shares its id with a near copy stays; rows
    equal in both go or stay together.
    """
    gone = joined_sets(docs, words, num, den, "doc_id", "text").redundant().select(
        F.col("doc_id").alias("__gone"), F.col("key").alias("__key"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (key == gone["__key"]), "left_anti")
