"""Readers and writers (S1-S12).

Readers return DataFrames with explicit schemas where the layout is known;
multi-file readers keep the file path (``_metadata.file_path``).  Writers
produce directories of part files as Spark does; ordered reports (CSV, Markdown)
are ordered parts, whose names sort as their lines do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve.functions.text import utrim


# ---------------------------------------------------------------- S1 / S2
def read_jsonl(spark: SparkSession, path, schema: T.StructType | str | None = None,
               strict: bool = True, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """One JSON object per line; blank lines skipped; a malformed line fails
    the job when ``strict``.

    Otherwise every line stays: a malformed one is a row whose ``corrupt_col``
    holds its text (null on the others).  ``split_corrupt`` parts the two.
    """
    if strict:
        r = spark.read.option("mode", "FAILFAST")
        return (r.schema(schema) if schema is not None else r).json(path)
    if schema is None:
        schema = spark.read.option("columnNameOfCorruptRecord", corrupt_col).json(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if corrupt_col not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_col, T.StringType())])
    # Parsed from the lines, as the JSON source cannot return the corrupt column alone.
    lines = spark.read.text(path).where(utrim(F.col("value")) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col}
    return lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")


def read_located_jsonl(spark: SparkSession, path: str, schema, per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of JSON lines: ``file`` and ``line_no`` (from 1, blank lines count) with the fields
    of ``schema``, and with the ``line`` of each that is no JSON object of that schema.  Blank lines are neither.

    ``per_file=False`` counts on from file to file, in the order of their paths.
    """
    lines = numbered_lines(spark, path, per_file=per_file).where(utrim(F.col("value")) != "").select(
        "file", (F.col("pos") + 1).alias("line_no"), "value")
    fields = schema if isinstance(schema, str) else schema.toDDL()
    bad = F.col("r.__corrupt").isNotNull()
    parsed = lines.select("*", F.from_json("value", f"{fields}, __corrupt string",
                                           {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}).alias("r"))
    return (parsed.where(~bad).select("file", "line_no", "r.*").drop("__corrupt"),
            parsed.where(bad).select("file", "line_no", F.col("value").alias("line")))


def split_corrupt(df: DataFrame, corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, quarantine of malformed lines) of ``read_jsonl(strict=False)``."""
    good = df.where(F.col(corrupt_col).isNull()).drop(corrupt_col)
    return good, df.where(F.col(corrupt_col).isNotNull()).select(F.col(corrupt_col).alias("line"))


def read_named_splits(spark: SparkSession, paths: dict, schema=None, split_col: str = "split") -> DataFrame:
    """Several files as named splits in one DataFrame (``{"train": p1, "eval": p2}``)."""
    dfs = [read_jsonl(spark, p, schema).withColumn(split_col, F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ---------------------------------------------------------------- S3
def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = True, per_file: bool = False) -> DataFrame:
    """``file``, ``pos`` (from 0), ``value``: the lines of text files, numbered in file order.

    A line's place is its place in its split plus the lines of the splits
    before, by file path and the split's first byte; nothing depends on the order in
    which Spark plans or runs splits.  Places in a split are counted while it
    streams by; the table of counts has a row per split, and is the only one
    that is put in order.  The lines themselves are neither sorted nor written.
    ``per_file`` numbers each file from 0.
    """
    split = ["file", "block"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"))
    if not keep_blank:
        raw = raw.where(utrim(F.col("value")) != "")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        at, last = 0, None
        for b in batches:
            places, start = np.empty(b.num_rows, np.int64), 0
            file, block = (b.column(i).dictionary_encode() for i in (1, 2))
            code = file.indices.to_numpy().astype(np.int64) * (len(block.dictionary) + 1) + block.indices.to_numpy()
            for end in [*(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]:
                if end == start:
                    continue
                own = b.column(1)[start].as_py(), b.column(2)[start].as_py()
                at, last = (at if own == last else 0), own
                places[start:end] = np.arange(at, at + end - start)
                at, start = at + end - start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places)], names=["value", *split, "place"])

    placed = raw.mapInArrow(run, "value string, file string, block long, place long")
    counts = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy(*split)).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, split).select("file", (F.col("offset") + F.col("place")).alias("pos"), "value")


def read_ordered_lines(spark: SparkSession, path: str, pos_col: str = "pos", text_col: str = "text",
                       start: int = 0) -> DataFrame:
    """Non-blank lines of one or more text files, trimmed, numbered in file order."""
    return numbered_lines(spark, path, keep_blank=False).select(
        (F.col("pos") + start).alias(pos_col), utrim(F.col("value")).alias(text_col))


# ---------------------------------------------------------------- S4
def read_labelled_dialogues(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Raw labelled lines ``label<sep>turn<sep>...<sep>reply`` ->
    (label, turns = context turns, reply, line)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.col("value"), sep)
    n = F.size(parts)
    return lines.select(
        F.element_at(parts, 1).cast("int").alias("label"),
        F.when(n > 2, F.slice(parts, 2, n - 2)).otherwise(F.array().cast("array<string>")).alias("turns"),
        F.when(n > 1, F.element_at(parts, -1)).alias("reply"),
        F.col("value").alias("line"))


# ---------------------------------------------------------------- S5 / S6
def with_run_dirs(df: DataFrame) -> DataFrame:
    """Add the directory, its name and the path of each row's file (from ``_metadata``)."""
    fp = F.col("_metadata.file_path")
    parent = F.regexp_replace(F.regexp_replace(fp, "^file:", ""), "/[^/]*$", "")
    return df.withColumn("run_dir", parent).withColumn("run_name", F.regexp_extract(parent, "([^/]+)$", 1)) \
        .withColumn("source_file", fp)


def read_run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """One pretty-printed JSON object per run directory (``*/summary.json``),
    with the run directory and its name; rows in path order."""
    df = spark.read.option("multiLine", True).json(pattern)
    return with_run_dirs(df.select("*", "_metadata")).drop("_metadata").orderBy("source_file")


def read_trainer_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Trainer state files: one row per file with ``log_history`` and the run
    directory (the checkpoint's parent directory names the run)."""
    df = spark.read.option("multiLine", True).json(pattern)
    df = with_run_dirs(df.select("*", "_metadata")).drop("_metadata")
    run = F.regexp_extract(F.col("run_dir"), "([^/]+)/[^/]+$", 1)
    return df.withColumn("run", F.when(run != "", run).otherwise(F.col("run_name")))


# ---------------------------------------------------------------- S7 / S8 / S12
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines keeping null fields and non-ASCII text as is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


write_predictions_jsonl = write_jsonl
write_paired_json = write_jsonl


def write_summary_json(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row summary as a single JSON object (one row is one part)."""
    summary.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


# ---------------------------------------------------------------- S9 / S10 / S11
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of a table (already text) in their order, each part with the header, quoting fields with
    commas or quotes the way Python's csv module does.  ``csv_lines`` has the header once."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))


def csv_lines(df: DataFrame, order_col: str, columns: list[str] | None = None) -> DataFrame:
    """(order, line): the header, whose order is null and so comes first, and the rows as lines of CSV."""
    columns = columns or [c for c in df.columns if c != order_col]
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), options)
    body = df.select(F.col(order_col).alias("order"), line.alias("line"))
    names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(columns)]), options)
    head = df.sparkSession.range(1).select(F.lit(None).cast(body.schema["order"].dataType).alias("order"), names.alias("line"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, order_col: str = "order", text_col: str = "line",
                mode: str = "overwrite") -> None:
    """Ordered text lines (reports, CSV) as ordered parts: the files of ``path`` in name order, one after the
    other, are the whole.  A range partition deals the rows, so no task writes all."""
    lines.orderBy(order_col).select(text_col).write.mode(mode).text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``n_lines``, ``n_bytes`` of the parts that ``write_lines`` wrote (empty ones are left out)."""
    return (spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("part"))
            .agg(F.count(F.lit(1)).alias("n_lines"), F.first("_metadata.file_size").alias("n_bytes")))
