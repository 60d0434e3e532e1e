"""Token ids in ORC files, in ascending document order.

Each row of a file is a document: its id, the ids of its tokens (ORC's
integer run-length encoding packs them to about two bytes), their number and
its place in the file's stream of ids.  Row indexes and a Bloom filter on
``doc_id`` let a reader skip stripes; stripes are read in parallel.

Writing range-partitions the texts by id (one shuffle, of texts, which are
smaller than their ids), sorts inside the partitions and encodes slices of
bounded bytes.  Arrow splits and dictionary-encodes the strings between spaces
and line ends: the tokenizer drops white space, so no token, normalisation or
special token reaches across it.  Distinct strings and their pre-tokens are
encoded once a worker and remembered in a bounded table; the ids of the texts
are a gather.  Places over all files are the sums of the files before: one row
a file.

Defined results: null and empty texts have only the end id; very long texts are
slices of their own and are encoded whole; rows with equal or null ids keep a
defined order (nulls first, then by text); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, shared_path, ship_package
from chatsieve.llm.strings import LONGEST_KNOWN, Runs, WordTokenizer, slices, spelled, sums_by_text

END_ID = 2
KNOWN_STRINGS = 500_000  # strings and pre-tokens in a worker's table, about 100 MB
OPTIONS = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "10000",
           "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20)}


class Ids:
    """String without spaces or line ends -> its ids as little-endian 32-bit integers; the table is bounded."""

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer(path)
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.library.get_vocab_size())]
        self.known: dict[str, bytes] = {"": b""}

    def all(self, strings: list[str]) -> list[bytes]:
        return [self.new(s) if x is None else x for s, x in zip(strings, map(self.known.get, strings))]

    def new(self, s: str) -> bytes:
        if self.tokenizer.has_added(s):
            return self.remember(s, self.pack(self.tokenizer.encode(s)))
        parts = self.tokenizer.pre_tokens(s)
        return self.merged(s) if parts == [s] else self.remember(s, b"".join(map(self.merged, parts)))

    def merged(self, pre_token: str) -> bytes:
        # An ASCII pre-token is itself a string; others, in byte letters, keep apart (no string has a line end).
        key = pre_token if pre_token.isascii() else "\n" + pre_token
        out = self.known.get(key)
        return self.remember(key, self.pack(self.tokenizer.merge(pre_token))) if out is None else out

    def remember(self, s: str, out: bytes) -> bytes:
        if len(self.known) < KNOWN_STRINGS and len(s) < LONGEST_KNOWN:
            self.known[s] = out
        return out

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])


@lru_cache(maxsize=2)
def _known(path: str) -> Ids:
    return Ids(path)


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> pa.ListArray:
    """The ids of each text of a slice, with the end id."""
    strings, codes, starts = spelled(pc.replace_substring(texts, "\n", " "))
    runs = Runs([*_known(path).all(strings), end_id.to_bytes(4, "little")], "<i4")
    ids, n = runs.gather(np.insert(codes, starts[1:], len(strings)))
    n_ids = sums_by_text(n, starts + np.arange(len(starts)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()), pa.array(ids))


def token_bytes(text: str, path: str, end_id: int = END_ID) -> bytes:
    """The ids of one text as little-endian 32-bit integers."""
    return token_ids(pa.array([text]), path, end_id).flatten().to_numpy().astype("<u4").tobytes()


def write_tokens(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the ORC files to ``out_path``."""
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1):
                ids = token_ids(b.column(1), tokenizer_path, end_id)
                n = np.diff(ids.offsets.to_numpy())
                ends = np.cumsum(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), ids, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n)],
                    names=["doc_id", "ids", "n_tokens", "part", "part_start"])
                at += int(ends[-1])

    # The start of the text spreads rows of one id (or of none) over the tasks.
    ordered = (df.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text"))
    (ordered.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, part int, part_start long")
     .write.options(**OPTIONS).orc(out_path))


def read_tokens(spark: SparkSession, path: str, doc_ids=None) -> DataFrame:
    """The rows of the files; ``doc_ids`` (a short list) is pushed down to stripe statistics and Bloom filters."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files at ``path``."""
    df = read_tokens(spark, path)
    kind = df.schema["doc_id"].dataType.simpleString()
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(np.array(crc, dtype=np.int64))], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    own = df.select("doc_id", "ids", "part", "part_start").mapInArrow(
        run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    # One row a file: a window over all of them is small, and so is its broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return own.join(F.broadcast(sums), "part").select(
        "doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to the cluster's shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-orc")
    write_tokens(docs, tokenizer_path, path, end_id)
    return token_table(spark, path)
