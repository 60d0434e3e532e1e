"""The operators chained over ``documents``.

Language ID, exact dedup, near-duplicate join, mixing to target weights and
SentencePiece encoding, in this order.  Each stage takes all rows that the one
before kept, is written as Parquet to the cluster's shared folder and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatsieve.llm import exact_dedup, jaccard_join, language_ecoc, piece_bpe, pivotal_mix
from chatsieve.llm.common import documents, write_and_read
from chatsieve.llm.plans import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letter, ambiguous or a low score) go."""
    return language_ecoc.with_known_language(docs, language_ecoc.train_on_fold(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles one stays."""
    return jaccard_join.drop_near_duplicates(docs, words=5, num=4, den=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return pivotal_mix.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its pieces, with their number and digests."""
    return piece_bpe.round_trip(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard join", near_dedup),
          ("mixing sources to target weights", source_mix), ("SentencePiece encoding and decoding", piece_ids)]

# Trained classifiers, components and tokens are not expressible in SQL; tests hold
# every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
