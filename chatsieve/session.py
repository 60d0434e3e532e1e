"""Session helpers.

The library never creates its own cluster settings behind the caller's back;
``get_session`` is a convenience for tests, benchmarks and notebooks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job in this library: AQE re-plans joins and
# coalesces shuffle partitions at runtime (it is also what turns a join into a
# broadcast only after the real size of a side is known), and splits skewed
# join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoints written by the ranking and anchor helpers are removed once
    # the DataFrames that use them are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "chatsieve", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint directory named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset do we create one: under ``fallback`` where
    the caller names a folder, else a temporary one, and that only under a
    local master, as executors of a cluster would not see it.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - client sessions manage checkpoints server-side
        return current or ""
    sc_dir = sc.getCheckpointDir()
    if current:
        if not sc_dir:
            sc.setCheckpointDir(current)
        return current
    if sc_dir:
        return sc_dir
    local = sc.master == "local" or sc.master.startswith("local[")
    if not fallback and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="chatsieve-ckpt-")
    os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
