"""The first k rows of a table or of each group, without a task that holds k rows.

``orderBy().limit(k)`` keeps k rows a task and gathers them in one; a window
row number does the same for each group.  Both are fine for a small k only.
Here the k-th value of the order key is found instead: a histogram of the key
(partially aggregated: a task passes on its bucket counts) tells the bucket
that holds the k-th row, the next one covers that bucket alone, from its
smallest to its largest value, and so on until the value is known or few rows
are left.  Everything before the boundary is taken by a filter.  Rows of the
boundary itself (which may be a third of all where the key has ties) are
numbered over range partitions (``ranking.exact_row_number``).

The narrow table (row key, group, order key) is written once with
``checkpoint()``; histograms and boundaries have one row per group and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.operators.ranking import exact_row_number, null_safe_join
from chatsieve.session import ensure_checkpoint_dir

BUCKETS = 1024
FEW_ROWS = 1000  # a boundary of at most so many rows is numbered instead of split further


def _bucket() -> Column:
    """Equal widths from the smallest to the largest key: these two never share a bucket."""
    k, lo, hi = F.col("__k"), F.col("__lo"), F.col("__hi")
    width = hi - lo
    equal = F.least(F.floor((k - lo) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    far = F.when(k == lo, 0).when(k == hi, 2).otherwise(1)  # infinite keys, or a width beyond a double
    return F.when(width < F.lit(float("inf")), equal).otherwise(far)


def _boundaries(narrow: DataFrame, quotas: DataFrame) -> DataFrame:
    """(group, __lo, __hi, __n, __need): of the __n keys from __lo to __hi the first __need are taken, and all below."""
    per_group = narrow.groupBy("__g").agg(F.min("__k").alias("__lo"), F.max("__k").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    known = (null_safe_join(per_group, quotas, ["__g"])
             .select("__g", "__lo", "__hi", "__n", F.least("__n", F.col("__q").cast("long")).alias("__need"))
             .where("__need > 0").checkpoint(eager=True))
    unsettled = (F.col("__need") < F.col("__n")) & (F.col("__lo") < F.col("__hi")) & (F.col("__n") > FEW_ROWS)
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    while known.where(unsettled).limit(1).count():
        # Every round splits the smallest from the largest key, so it ends.
        inside = (null_safe_join(narrow, known.where(unsettled), ["__g"]).where("__k >= __lo and __k <= __hi")
                  .groupBy("__g", "__need", _bucket().alias("__b"))
                  .agg(F.min("__k").alias("__lo"), F.max("__k").alias("__hi"), F.count(F.lit(1)).alias("__n")))
        split = (inside.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))
                 .where("__below < __need and __need <= __below + __n")
                 .select("__g", "__lo", "__hi", "__n", (F.col("__need") - F.col("__below")).alias("__need")))
        known = known.where(~unsettled).unionByName(split).checkpoint(eager=True)
    return known


def first_rows(df: DataFrame, row_key: str, order: Column, ties: list, quotas, group: str | None = None) -> DataFrame:
    """The first rows of ``df`` by ``order``, then by the columns ``ties``.

    ``row_key`` is unique.  ``order`` is a number, smallest first; a null comes
    last.  ``ties`` end with ``row_key``, so that the order is total.  ``quotas``
    is a number of rows or, for each ``group`` (a null group is one), a table
    (group, quota); groups without a quota give no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tie = [(F.col(t) if isinstance(t, str) else t).alias(f"__t{i}") for i, t in enumerate(ties)]
    key = order.cast("double")
    narrow = df.select(
        F.col(row_key).alias("__id"), (F.col(group) if group else F.lit(0)).alias("__g"),
        F.when(key.isNull() | F.isnan(key), F.lit(float("inf"))).otherwise(key + F.lit(0.0)).alias("__k"), *tie).checkpoint(eager=True)
    if group:
        name = [c for c in quotas.columns if c != group][0]
        quotas = quotas.select(F.col(group).alias("__g"), F.col(name).alias("__q"))
    else:
        quotas = df.sparkSession.range(1).select(F.lit(0).alias("__g"), F.lit(int(quotas)).cast("long").alias("__q"))
    marked = null_safe_join(narrow, _boundaries(narrow, quotas), ["__g"])
    whole = (F.col("__n") == F.col("__need")) & (F.col("__k") <= F.col("__hi"))
    sure = marked.where((F.col("__k") < F.col("__lo")) | whole).select("__id")
    edge = marked.where("__n > __need and __k >= __lo and __k <= __hi")
    ranked = exact_row_number(edge, ["__g"], ["__k", *[f"__t{i}" for i in range(len(ties))]], "__rank")
    chosen = sure.unionByName(ranked.where("__rank <= __need").select("__id")).withColumnRenamed("__id", row_key)
    return df.join(chosen, row_key, "left_semi")
