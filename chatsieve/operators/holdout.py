"""Hold-out exclusion (C25): rows that contain an item of a test set verbatim.

An inverted index of winnowed fingerprints with their places: of every
``window`` character k-grams in a row the one with the smallest hash is a
fingerprint.  The choice depends on these characters alone, so a text that
holds an item of at least ``k + window - 1`` characters has the item's
fingerprints at the same distances.  Each item is looked up by the one of its
fingerprints that fewest rows hold, and the place of a hit says where the item
must begin, so a candidate is confirmed by one slice of the text.

Items shorter than that take part in the same pass: all their k-grams (or,
below k characters, the item itself as one gram) are fingerprints.

Rows only give the fingerprints that may be an item's, by a bitmap of fixed
size over the items' hashes; false ones end in the join.  So the index that
is shuffled grows with the matches, not with the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions import rolling
from chatsieve.functions.text import normalize_key
from chatsieve.session import ensure_checkpoint_dir

WANTED_BITS = 1 << 22  # of the bitmap: half a megabyte, whatever the number of items
BUCKET_BITS = 1 << 15  # of each bitmap that Spark's bitmap aggregate builds


def exclude_holdout(df: DataFrame, holdout: DataFrame, c="question", holdout_col="text") -> DataFrame:
    """Drop rows whose normalised text equals a hold-out item's normalised text."""
    column = lambda x: F.col(x) if isinstance(x, str) else x
    keys = holdout.select(normalize_key(column(holdout_col)).alias("__hk")).where(F.col("__hk").isNotNull())
    return (df.withColumn("__hk", normalize_key(column(c)))
            .join(keys.distinct(), on="__hk", how="left_anti").drop("__hk"))


def _wanted(item_prints: DataFrame) -> bytes:
    """Bitmap of the items' hashes (their lowest bits); its size is fixed, so the driver may hold it."""
    low = F.col("__h").bitwiseAND(F.lit(WANTED_BITS - 1))
    rows = (item_prints.select(F.shiftright(low, 15).cast("int").alias("bucket"), low.bitwiseAND(F.lit(BUCKET_BITS - 1)).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())  # 128 rows at most
    out = bytearray(WANTED_BITS // 8)
    for r in rows:
        out[r["bucket"] * BUCKET_BITS // 8:(r["bucket"] + 1) * BUCKET_BITS // 8] = r["bits"]
    return bytes(out)


def flag_contained_holdout(df: DataFrame, holdout: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str,
                           k: int = 12, window: int = 16, modulus: int | None = None) -> DataFrame:
    """Pairs (row, hold-out item) where the row's text contains the item's text verbatim.

    Exact: winnowing guarantees a shared fingerprint for long items, all grams
    stand for shorter ones, and every candidate is compared with the text.
    Null and empty items and null texts match nothing; rows and items without
    an id cannot be named and are in no pair; a pair is given once.  ``modulus``
    is the former name of ``window``.
    """
    window = modulus or window
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__rid"), F.col(text_col).alias("__rtext"))
    items = (holdout.select(F.col(item_id).alias("__iid"), F.col(item_text).alias("__itext"))
             .where(F.char_length("__itext") > 0))
    n = F.char_length("__itext")
    kinds = items.select(F.when(n >= k + window - 1, F.lit(0)).otherwise(F.least(n, F.lit(k))).alias("n")).distinct()
    lengths = sorted(r["n"] for r in kinds.collect())  # k + 1 values at most

    kind = {c: f.dataType.simpleString() for c, f in (("r", rows.schema["__rid"]), ("i", items.schema["__iid"]))}
    item_prints = items.mapInArrow(lambda b: rolling.item_fingerprints(b, k, window),
                                   f"__iid {kind['i']}, __ipos long, __h long").checkpoint(eager=True)
    wanted = _wanted(item_prints)
    row_prints = rows.mapInArrow(lambda b: rolling.row_fingerprints(b, k, window, lengths, wanted),
                                 f"__rid {kind['r']}, __rpos long, __h long").checkpoint(eager=True)
    held = row_prints.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    rarest = (item_prints.join(held, "__h", "left").groupBy("__iid")
              .agg(F.min_by(F.struct("__h", "__ipos"), F.struct(F.coalesce("__n", F.lit(0)), "__h", "__ipos")).alias("p"))
              .select("__iid", "p.__h", "p.__ipos"))
    places = (rarest.join(row_prints, "__h").select("__iid", "__rid", (F.col("__rpos") - F.col("__ipos")).alias("__at"))
              .where("__at >= 0").distinct())
    return (places.join(items, "__iid").join(rows, "__rid")
            .where(F.substring(F.col("__rtext"), F.col("__at").cast("int") + 1, F.char_length("__itext")) == F.col("__itext"))
            .select(F.col("__rid").alias(id_col), F.col("__iid").alias(item_id)).distinct())


def exclude_contained_holdout(df: DataFrame, holdout: DataFrame, id_col: str, text_col: str,
                              item_id: str, item_text: str, **kw) -> DataFrame:
    hits = flag_contained_holdout(df, holdout, id_col, text_col, item_id, item_text, **kw)
    return df.join(hits.select(id_col).distinct(), on=id_col, how="left_anti")
