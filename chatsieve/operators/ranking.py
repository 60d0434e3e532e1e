"""Exact ordered numbering and running aggregates without hot partitions.

A window ``partitionBy(g).orderBy(o)`` sends every row of group ``g`` to one
task.  When a group may hold a third of all rows (or there are only a
handful of groups) that task becomes the job.  The helpers here instead:

1. range-partition the rows by ``(g, o)`` — the bounds come from a sample,
   so a large group is cut across many partitions;
2. number / scan the rows inside each partition;
3. compute, per ``(partition, g)``, a count or maximum (a table whose size
   is partitions x groups-per-partition) and turn it into an offset for the
   partitions that follow with a window that holds at most one row per
   partition;
4. add the offset back.

The range-partitioned, numbered rows are read by two branches (the rows
themselves and the per-partition counts).  Spark seeds the range sampler per
shuffle, so two independently planned exchanges may cut the data at
different bounds; the numbered rows are therefore written once with a
reliable ``checkpoint()`` (to the cluster's ``spark.checkpoint.dir``) and both
branches read that copy.  The checkpoint also cuts the lineage, so a lost
executor never recomputes a different partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.session import ensure_checkpoint_dir


def null_safe_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equal columns where a null matches a null (a null group is a group)."""
    on = list(on)
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__on_{i}") for i, c in enumerate(on)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in on])
    cond = [F.col(f"`{c}`").eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)]
    return left.join(renamed, cond, how).drop(*[f"__on_{i}" for i in range(len(on))])


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _range_numbered(df: DataFrame, parts: list, orders: list, num_partitions: int | None) -> DataFrame:
    """Rows range-partitioned by (parts, orders), sorted inside each
    partition, tagged with the partition id and a position id, written once
    to the checkpoint directory."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    keyed = (df.repartitionByRange(n, *_cols(parts + orders))
             .sortWithinPartitions(*_cols(parts + orders))
             .withColumn("__pid", F.spark_partition_id())
             .withColumn("__mid", F.monotonically_increasing_id()))
    return keyed.checkpoint(eager=True)


def exact_row_number(df: DataFrame, partition_cols, order_cols, out: str = "row_number",
                     num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` over ``partitionBy(partition_cols).orderBy(order_cols)``.

    ``order_cols`` must give a total order inside each group (end with a
    unique key).  ``partition_cols`` may be empty (a global numbering).
    Rows whose group is null form a group of their own.
    """
    parts = list(partition_cols)
    orders = list(order_cols)
    keyed = _range_numbered(df, parts, orders, num_partitions)
    stats = keyed.groupBy("__pid", *parts).agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*parts).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")
    joined = null_safe_join(keyed, stats, ["__pid", *parts])
    return (joined.withColumn(out, F.col("__off") + (F.col("__mid") - F.col("__first")) + 1)
            .drop("__pid", "__mid", "__first", "__off"))


def running_max(df: DataFrame, partition_cols, order_cols, value: str, out: str = "running_max",
                num_partitions: int | None = None) -> DataFrame:
    """Running maximum of ``value`` over ``partitionBy(..).orderBy(..)`` rows
    ``unboundedPreceding .. currentRow``, computed without a per-group task.

    Inside a range partition the running max is a window on
    ``(partition id, group)`` — bounded by the partition size; the carry
    from earlier partitions is the max of their per-group maxima.
    """
    parts = list(partition_cols)
    orders = list(order_cols)
    n = _num_partitions(df, num_partitions)
    # One reducer per range partition: a range exchange on the partition id
    # also satisfies the window's clustering on (partition id, group), so no
    # hash exchange (whose collisions would stack partitions) is added.
    keyed = _range_numbered(df, parts, orders, num_partitions).drop("__mid") \
        .repartitionByRange(n, "__pid")
    local_w = Window.partitionBy("__pid", *parts).orderBy(*_cols(orders)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = keyed.withColumn("__local", F.max(value).over(local_w))
    stats = keyed.groupBy("__pid", *parts).agg(F.max(value).alias("__pmax"))
    w = Window.partitionBy(*parts).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("__carry", F.max("__pmax").over(w)).drop("__pmax")
    joined = null_safe_join(keyed, stats, ["__pid", *parts])
    best = F.when(F.col("__carry").isNull(), F.col("__local")) \
        .when(F.col("__local").isNull(), F.col("__carry")) \
        .otherwise(F.greatest("__local", "__carry"))
    return joined.withColumn(out, best).drop("__pid", "__local", "__carry")
