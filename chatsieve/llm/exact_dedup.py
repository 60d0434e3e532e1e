"""Exact duplicates by content hash, confirmed byte by byte.

Texts are grouped by their 128-bit MD5 value; of each group the row with the
smallest (or largest) id stays.  A hash may collide, so inside each group
every text is compared with the text of the row that stays; rows that differ
(a collision) are grouped again by the text itself.

Shuffles: narrow ``(id, hash)`` rows for the group sizes, with partial
aggregation, so a text with a billion copies is one row per task; then the
texts once, for the hash groups of two rows or more.  Both joins are
equi-joins on the hash whose large side AQE can split.

Defined results: null text counts as empty; null ids never become ``keep_id``
unless the whole group has none; rows equal in id and text carry the same
verdict (``drop_exact_copies`` leaves one of them); an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text, write_and_read


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: str = "min", hash_expr=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" or "max", the id that stays.  ``hash_expr`` (a function of
    the text column) replaces the 128-bit hash; tests use it to force collisions.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    pick = F.min if keep == "min" else F.max
    make_hash = hash_expr or (lambda t: F.unhex(F.md5(t.cast("binary"))))
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", make_hash(F.col("text")).alias("h"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("keep_id"))

    single = (rows.select("doc_id", "h", "text_sha256").join(sizes.where("n = 1"), "h")
              .select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256"))

    # Written once: both sides of the comparison read it, and the texts are shuffled once.
    members = write_and_read(rows.join(sizes.where("n > 1"), "h"), "exact-members")
    leaders = (members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .groupBy("h").agg(F.min("text").alias("lead_text")))
    same = F.col("text") == F.col("lead_text")
    compared = write_and_read(
        members.join(leaders, "h").select(
            "doc_id", "h", "n", "keep_id", "text_sha256", same.alias("same"),
            F.when(~same, F.col("text")).alias("other_text")), "exact-dedup")

    collided = compared.where(~F.col("same")).select("doc_id", "h", "other_text", "text_sha256")
    lost = collided.groupBy("h").agg(F.count(F.lit(1)).alias("lost"))
    equal = (compared.where("same").join(lost, "h", "left")
             .select("doc_id", "keep_id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
                     "text_sha256"))
    regrouped = collided.groupBy("h", "other_text").agg(
        F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
    apart = (collided.join(regrouped, ["h", "other_text"])
             .select("doc_id", "keep_id", "group_size", "text_sha256"))

    out = single.unionByName(equal).unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = (exact_duplicates(docs, id_col, text_col, keep).where("kept")
            .groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
            .agg(F.count(F.lit(1)).alias("__times")))
    keyed = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    found = keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")))
    # Only rows that share id and text have to meet once more.
    once = found.where("__times = 1").unionByName(found.where("__times > 1").dropDuplicates([id_col, "__sha"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
