"""Pieces that several operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.session import ensure_checkpoint_dir

# Words are runs of anything but the six ASCII white-space characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty), whatever else the input carries."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """White-space separated words of ``text`` (never null or empty strings)."""
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def in_remainder(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text leaves ``remainder``; a null id never does."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends, not when the driver next happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, drop its shuffle files and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(df: DataFrame) -> None:
    """Delete the folder of a table that ``write_and_read`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: list = []


def sole_tables(*caches) -> None:
    """Called in a Python worker: drop what other operators' cached functions hold there.

    Spark uses a worker for many stages, so the tables of an operator would stay
    beside those of the next one.
    """
    for c in _HELD:
        if c not in caches:
            c.cache_clear()
    _HELD[:] = caches


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Nothing happens where it is on the workers' path already (installed, or by
    PYTHONPATH); else Spark sends the executors a zip of it, once an application.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or root in on_path or os.path.basename(root) == "site-packages":
        return
    _SHIPPED.add(app)
    base = os.path.join(tempfile.mkdtemp(prefix="chatsieve-zip-"), "chatsieve")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "chatsieve"))
