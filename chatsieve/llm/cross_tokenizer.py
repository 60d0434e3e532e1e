"""Alignment of two tokenizers, with corpus-wide counts of aligned token pairs.

First pass: documents go through in slices of bounded bytes (chunks).  Each chunk
gives its linked id pairs with the number of its documents that hold them, as
sorted arrays by shard (a hash of the first id, so that all pairs of an id
share one), and its documents, packed.

The pairs of a task's chunks are merged before they are shuffled, and their
distinct ones united up a tree of bounded fan-in.  Each shard gets a minimal
perfect hash: levels of bit arrays, in which a pair takes the place that it
alone falls on, or goes on to the next level; a set bit's rank is the pair's
slot.  Counts are dense vectors over the slots, summed up the same tree; the
key in each slot is kept and compared in every lookup.  The highest count of
each first id is found in its shard.

Second pass: each chunk's pairs are answered from their shards and meet the
chunk's documents, which are aligned again and look their pairs up.  Shards and
chunks are bounded (vocabulary sizes, slice bytes), so every group of a job is;
nothing is broadcast or collected.

Defined results: null and empty texts, and texts whose tokens of either side
do not give their bytes back, have zeros and an empty string; very long texts are
chunks of their own and aligned whole; repeated rows count as documents each;
ties for an id's highest count are all best; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, ship_package, write_and_read
from chatsieve.llm.strings import slices, summed
from chatsieve.llm.token_units import Texts, sums, tokenizer_pair

SHARDS = 128
FAN_IN = 32
HELD_BYTES = 32 << 20  # of pairs that a task merges before it lets them go
CHUNK = "chunk long, shard int, keys binary, counts binary, docs binary"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


# -- minimal perfect hashing -------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of ``keys``; every seed is another hash function."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys; ``slots`` of other keys are -1."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys  # bits by level, and the key in each slot
        self.ranks = np.cumsum(np.concatenate(levels), dtype=np.int64) - 1 if levels else np.empty(0, np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, placed, left = [], [], keys
        while len(left):
            size = 2 * len(left)
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            alone = bits[at]
            placed.append(left[alone][np.argsort(at[alone])])
            levels.append(bits)
            left = left[~alone]
        return cls(levels, np.concatenate(placed) if placed else keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, offset = np.arange(len(keys)), 0
        for i, bits in enumerate(self.levels):
            at = (mixed(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = self.ranks[offset + at[here]]
            left, offset = left[~here], offset + len(bits)
        there = out >= 0
        there[there] = self.keys[out[there]] == keys[there]
        return np.where(there, out, -1)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes, keys: np.ndarray) -> "PerfectHash":
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            packed = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels, keys)


# -- pairs -------------------------------------------------------------------

def key_type(n_a: int, n_b: int):
    return np.uint32 if n_a * n_b < 1 << 32 else np.uint64


def shard_of(first: np.ndarray) -> np.ndarray:
    return (mixed(first, 99) % np.uint64(SHARDS)).astype(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    """Non-negative integers in 4 bytes each where they fit, else in 8."""
    small = not len(counts) or counts.max() < 1 << 32
    return counts.astype(np.uint32 if small else np.uint64).tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """In order (a sort, which is faster here than numpy's hashing ``unique``)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def linked_pairs(texts: Texts, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (first id * n_b + second id) of the slice and how many of its texts hold them."""
    found = []
    for rows, codes, starts, links in texts.parts:
        keys, link_key = np.unique(links.link_a.astype(np.int64) * n_b + links.link_b, return_inverse=True)
        n_units = len(links.n_links)
        doc_unit = distinct(np.repeat(np.arange(len(rows)), np.diff(starts)) * n_units + codes)
        doc, unit = doc_unit // n_units, doc_unit % n_units
        n = links.n_links[unit]
        ends = np.cumsum(n)
        link = np.repeat(np.cumsum(links.n_links)[unit] - ends, n) + np.arange(len(doc) and ends[-1])
        held = distinct(np.repeat(doc, n) * len(keys) + link_key[link]) % max(len(keys), 1)
        found.append((keys, np.bincount(held, minlength=len(keys))))
    return summed(np.concatenate([[], *[k for k, _ in found]]).astype(np.int64),
                  np.concatenate([[], *[c for _, c in found]]).astype(np.int64))


def by_shard(keys: np.ndarray, n_b: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that occur and the places of their keys, in order."""
    shards = shard_of(keys // n_b)
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(shards[places[0]]), places


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def chunked(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each chunk's documents, and one for each shard of its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        kind = key_type(pair.n_a, pair.n_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, 1):
                keys, counts = linked_pairs(Texts(pair, b.column(1)), pair.n_b)
                rows = [(s, keys[at].astype(kind).tobytes(), narrow(counts[at]), None) for s, at in by_shard(keys, pair.n_b)]
                shards, ks, cs, docs = zip(*rows, (-1, None, None, pack(b)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(shards), pa.int64()), pa.array(shards, pa.int32()), pa.array(ks, pa.binary()),
                     pa.array(cs, pa.binary()), pa.array(docs, pa.binary())], names=["chunk", "shard", "keys", "counts", "docs"])
                chunk += 1

    return df.mapInArrow(run, CHUNK)


def merged_in_task(pairs: DataFrame, kind) -> DataFrame:
    """(part, shard, keys, counts): the rows of a task, merged while they fit in ``HELD_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def out():
            rows = [(s, *summed(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x])))
                    for s, x in sorted(held.items())]
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), pa.array([s for s, _, _ in rows], pa.int32()),
                 pa.array([k.tobytes() for _, k, _ in rows], pa.binary()),
                 pa.array([narrow(c) for _, _, c in rows], pa.binary())], names=["part", "shard", "keys", "counts"])

        for b in batches:
            for shard, k, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys = np.frombuffer(k, kind)
                held.setdefault(shard, []).append((keys, widened(c, len(keys))))
                size += 12 * len(keys)
                if size > HELD_BYTES:
                    yield out()
                    part, held, size = part + 1, {}, 0
        if held:
            yield out()

    return pairs.select("shard", "keys", "counts").mapInArrow(run, "part long, shard int, keys binary, counts binary")


def up_the_tree(rows: DataFrame, n: int, columns: str, combine: Callable[[pa.Table], dict]) -> DataFrame:
    """Combine the rows of each shard, ``FAN_IN`` at a time, until one is left of each.

    ``n`` is the number of parts that a shard's rows have at most.
    """
    while True:
        n = -(-n // FAN_IN)

        def run(table: pa.Table) -> pa.Table:
            row = {"part": table["slot"][0].as_py(), "shard": table["shard"][0].as_py(), **combine(table)}
            return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64() if k == "part" else pa.int32())
                             for k, v in row.items()})

        rows = (rows.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(n)))
                .groupBy("shard", "slot").applyInArrow(run, f"part long, shard int, {columns}"))
        if n == 1:
            return rows.drop("part")


def pair_counts(merged: DataFrame, n_parts: int, n_b: int, kind) -> DataFrame:
    """(shard, hash, keys, counts, best): a shard's perfect hash and, by slot, its keys, their counts and whether
    a count is the highest of its first id."""
    def united(table: pa.Table) -> dict:
        return {"keys": distinct(np.concatenate([np.frombuffer(k, kind) for k in table["keys"].to_pylist()])).tobytes()}

    def hashed(table: pa.Table) -> pa.Table:
        h = PerfectHash.of(np.frombuffer(table["keys"][0].as_py(), kind))
        return pa.table({"shard": table["shard"].cast(pa.int32()), "hash": [h.to_bytes()], "keys": [h.keys.tobytes()]})

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        """The counts of some rows of a shard as a vector over its slots."""
        if not left.num_rows:
            return EMPTY_VECTORS
        slot_keys = np.frombuffer(right["keys"][0].as_py(), kind)
        h, total = PerfectHash.from_bytes(right["hash"][0].as_py(), slot_keys), np.zeros(len(slot_keys), np.int64)
        for k, c in zip(left["keys"].to_pylist(), left["counts"].to_pylist()):
            keys = np.frombuffer(k, kind)
            at = h.slots(keys)
            if (at < 0).any():
                raise ValueError("a pair is not in its shard's hash")
            total[at] += widened(c, len(keys))
        return pa.table({"part": left["slot"][:1], "shard": left["shard"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    def added(table: pa.Table) -> dict:
        return {"counts": sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()).tobytes()}

    def highest(table: pa.Table) -> pa.Table:
        keys, counts = np.frombuffer(table["keys"][0].as_py(), kind), np.frombuffer(table["counts"][0].as_py(), np.int64)
        _, first = np.unique(keys // kind(n_b), return_inverse=True)
        top = np.zeros(first.max() + 1, np.int64)
        np.maximum.at(top, first, counts)
        return pa.table({"shard": table["shard"], "hash": table["hash"], "keys": table["keys"], "counts": table["counts"],
                         "best": pa.array([(counts == top[first]).tobytes()], pa.binary())})

    shard_hash = write_and_read(
        up_the_tree(merged.select("part", "shard", "keys"), n_parts, "keys binary", united)
        .groupBy("shard").applyInArrow(hashed, "shard int, hash binary, keys binary"), "pair-hash")
    slots = -(-n_parts // FAN_IN)
    vectors = (merged.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(slots))).groupBy("shard", "slot")
               .cogroup(for_each_slot(shard_hash, slots).groupBy("shard", "slot"))
               .applyInArrow(dense, "part long, shard int, counts binary"))
    total = up_the_tree(vectors, slots, "counts binary", added)
    return write_and_read(shard_hash.join(total, "shard").groupBy("shard").applyInArrow(
        highest, "shard int, hash binary, keys binary, counts binary, best binary"), "pair-counts")


EMPTY_VECTORS = pa.table({"part": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
EMPTY_ANSWERS = pa.table({"chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})


def for_each_slot(rows: DataFrame, slots: int) -> DataFrame:
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))


def answers(pairs: DataFrame, counts: DataFrame, n_chunks: int, kind) -> DataFrame:
    """(chunk, keys, values): the counts of a chunk's pairs, doubled, plus one where they are their first id's highest."""
    slots = -(-n_chunks // FAN_IN)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return EMPTY_ANSWERS
        h = PerfectHash.from_bytes(right["hash"][0].as_py(), np.frombuffer(right["keys"][0].as_py(), kind))
        value = np.frombuffer(right["counts"][0].as_py(), np.int64) * 2 + np.frombuffer(right["best"][0].as_py(), bool)
        own = [narrow(value[h.slots(np.frombuffer(k, kind))]) for k in left["keys"].to_pylist()]
        return pa.table({"chunk": left["chunk"], "keys": left["keys"], "values": pa.array(own, pa.binary())})

    return (pairs.select("chunk", "shard", "keys", F.pmod(F.xxhash64("chunk"), F.lit(slots)).alias("slot"))
            .groupBy("shard", "slot").cogroup(for_each_slot(counts, slots).groupBy("shard", "slot"))
            .applyInArrow(run, "chunk long, keys binary, values binary"))


def looked_up(batch: pa.RecordBatch, keys: np.ndarray, values: np.ndarray, pair) -> pa.Table:
    """The result rows of a chunk's documents; ``keys`` are its pairs in order, ``values`` their answers."""
    numbers = {name: np.zeros(batch.num_rows, np.int64) for name in NUMBERS}
    digests = [""] * batch.num_rows
    for rows, codes, starts, links in Texts(pair, batch.column(1)).parts:
        wanted = links.link_a.astype(np.int64) * pair.n_b + links.link_b
        at = np.searchsorted(keys, wanted)
        if (at == len(keys)).any() or (keys[at] != wanted).any():
            raise ValueError("a pair of the second pass is not one of the first")
        ends = np.cumsum(links.n_links)
        unit_links = np.concatenate([[0], ends])
        by_unit = {"n_a": links.n_a, "n_b": links.n_b, "n_groups": links.n_groups, "n_links": links.n_links,
                   "n_best": sums(values[at] & 1, unit_links), "count_sum": sums(values[at] >> 1, unit_links)}
        for name, x in by_unit.items():
            numbers[name][rows] = sums(x[codes], starts)
        groups = np.array(links.groups(), dtype=object)
        for i, row in enumerate(rows.tolist()):
            digests[row] = hashlib.sha256(";".join(groups[codes[starts[i]:starts[i + 1]]]).encode()).hexdigest()
    return pa.table({"doc_id": batch.column(0), **{k: pa.array(v) for k, v in numbers.items()}, "groups_sha256": digests})


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level file of the tokenizers library, ``b_path`` a sentencepiece model.
    """
    df = id_and_text(docs, id_col, text_col)
    doc_id = df.schema["doc_id"].dataType.simpleString()
    ship_package(df.sparkSession)
    pair = tokenizer_pair(a_path, b_path)
    n_b, kind = pair.n_b, key_type(pair.n_a, pair.n_b)

    chunks = write_and_read(chunked(df, a_path, b_path), "pair-chunks")
    pairs, packed = chunks.where("shard >= 0"), chunks.where("shard < 0").select("chunk", "docs")
    merged = write_and_read(merged_in_task(pairs, kind), "pair-merged")
    n_parts = max(1, merged.select("part").distinct().count())
    n_chunks = max(1, packed.count())
    counts = pair_counts(merged, n_parts, n_b, kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k, kind).astype(np.int64), v) for k, v in
                 zip(left["keys"].to_pylist(), left["values"].to_pylist())]
        keys = np.concatenate([np.empty(0, np.int64), *[k for k, _ in parts]])
        values = np.concatenate([np.empty(0, np.int64), *[widened(v, len(k)) for k, v in parts]])
        order = np.argsort(keys, kind="stable")
        return pa.concat_tables(looked_up(unpack(raw), keys[order], values[order], tokenizer_pair(a_path, b_path))
                                for raw in right["docs"].to_pylist())

    return (answers(pairs, counts, n_chunks, kind).groupBy("chunk").cogroup(packed.groupBy("chunk"))
            .applyInArrow(run, f"doc_id {doc_id}, " + ", ".join(f"{x} long" for x in NUMBERS) + ", groups_sha256 string"))


def aligned_pairs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus-wide table (a_id, b_id, n_docs, best): one row for each linked pair of ids."""
    df = id_and_text(docs, id_col, text_col)
    ship_package(df.sparkSession)
    pair = tokenizer_pair(a_path, b_path)
    n_b, kind = pair.n_b, key_type(pair.n_a, pair.n_b)
    merged = write_and_read(merged_in_task(chunked(df, a_path, b_path).where("shard >= 0"), kind), "pair-merged")
    counts = pair_counts(merged, max(1, merged.select("part").distinct().count()), n_b, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c, best in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys = np.frombuffer(k, kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys // n_b).astype(np.int32)), pa.array((keys % n_b).astype(np.int32)),
                     pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(best, bool))],
                    names=["a_id", "b_id", "n_docs", "best"])

    return counts.select("keys", "counts", "best").mapInArrow(run, "a_id int, b_id int, n_docs long, best boolean")
