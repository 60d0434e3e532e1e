"""Logs and metrics of any shape (S5, S6, L5, L10) as VARIANT.

Run summaries and trainer logs differ by file: a record holds the metrics that
its trainer wrote, at any depth.  Nothing here needs a schema or metric names:
JSON is parsed to VARIANT, objects and arrays are exploded level by level, and
every number found is a point of the series that its path names.  Malformed
JSON is a row of the quarantine, not a null record.

The number of levels is that of the deepest record, found by one aggregate over
the records' brackets; each level is one narrow generator, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.sources.io import with_run_dirs

SEP = "__"


def parse_records(df: DataFrame, json_col: str, out: str = "record") -> tuple[DataFrame, DataFrame]:
    """(rows with ``json_col`` parsed into ``out``, quarantine of the rows whose text is null or no JSON)."""
    parsed = df.withColumn(out, F.try_parse_json(json_col))
    return parsed.where(F.col(out).isNotNull()).drop(json_col), parsed.where(F.col(out).isNull()).drop(out)


def explode_variant(df: DataFrame, column: str) -> DataFrame:
    """A row for each field of an object or element of an array: ``__pos``, ``__key`` (null in arrays), ``__value``."""
    tvf = df.sparkSession.tvf.variant_explode(F.col(column).outer()).toDF("__pos", "__key", "__value")
    return df.lateralJoin(tvf)


STRINGS_AND_REST = r'"(?:\\.|[^"\\])*+"|[^\[\]{}"]+'  # all of a JSON text but its brackets


def depth(df: DataFrame, column: str) -> int:
    """How deep the deepest record nests (0: scalars only)."""
    brackets = F.split(F.regexp_replace(F.to_json(column), STRINGS_AND_REST, ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at, c):
        now = at["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return df.agg(F.max(F.aggregate(brackets, zero, step, lambda at: at["most"])).alias("d")).first()["d"] or 0


def leaves(df: DataFrame, column: str, keep: list[str], levels: int | None = None) -> DataFrame:
    """``keep``, ``path`` (keys joined by two underscores, elements as their number), ``type``, ``leaf`` (VARIANT).

    One row for each scalar of each record, JSON nulls included; empty objects
    and arrays have none.  A record that is a scalar itself has an empty path.
    """
    levels = depth(df, column) if levels is None else levels
    level = df.select(*keep, F.lit("").alias("path"), F.col(column).alias("leaf"))
    out = None
    for i in range(levels + 1):
        kind = F.regexp_extract(F.schema_of_variant("leaf"), "^[A-Z]+", 0)
        typed = level.withColumn("type", kind)
        scalars = typed.where(~F.col("type").isin("OBJECT", "ARRAY"))
        out = scalars if out is None else out.unionByName(scalars)
        if i == levels:
            break
        name = F.coalesce("__key", F.col("__pos").cast("string"))
        down = explode_variant(typed.where(F.col("type").isin("OBJECT", "ARRAY")), "leaf").where("__pos is not null")
        level = down.select(*keep, F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit(SEP), name)).alias("path"),
                            F.col("__value").alias("leaf"))
    return out.select(*keep, "path", "type", "leaf")


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def numeric_series(df: DataFrame, column: str, keep: list[str], step: str = "step", levels: int | None = None) -> DataFrame:
    """``keep``, ``step``, ``series``, ``value``: every number of every record that has a ``step``, by its path.

    The step itself is no series; text, booleans and nulls are none either.
    """
    at = F.try_variant_get(F.col(column), f"$['{step}']", "double")
    stepped = df.withColumn("__step", at).where(F.col("__step").isNotNull())
    found = leaves(stepped, column, [*keep, "__step"], levels).where(F.col("type").isin(*NUMBERS) & (F.col("path") != step))
    return found.select(*keep, F.col("__step").alias("step"), F.col("path").alias("series"),
                        F.try_variant_get("leaf", "$", "double").alias("value"))


def flatten_records(df: DataFrame, column: str, keep: list[str], levels: int | None = None) -> DataFrame:
    """``keep``, ``path``, ``type``, ``value`` (as text; null for a JSON null) of every scalar."""
    return leaves(df, column, keep, levels).select(
        *keep, "path", "type", F.try_variant_get("leaf", "$", "string").alias("value"))


def field_profile(df: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """``path``, ``type``, ``n``: which fields the records have, of which types, and in how many places."""
    return leaves(df, column, [], levels).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


def read_json_files(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """One JSON value per file: (``run_dir``, ``run_name``, ``source_file``, ``record``) and the quarantine of files
    that are no JSON (their text in ``value``)."""
    files = spark.read.text(pattern, wholetext=True)
    return parse_records(with_run_dirs(files.select("value", "_metadata")).drop("_metadata"), "value")


def log_records(files: DataFrame, column: str = "record", field: str = "log_history") -> DataFrame:
    """``run`` (the directory above the checkpoint's), ``pos``, ``record``: the entries of each trainer state file."""
    run = F.regexp_extract(F.col("run_dir"), "([^/]+)/[^/]+$", 1)
    history = files.select(F.when(run != "", run).otherwise(F.col("run_name")).alias("run"),
                           F.try_variant_get(F.col(column), f"$.{field}", "variant").alias("__h"))
    return explode_variant(history, "__h").where("__pos is not null").select(
        "run", F.col("__pos").alias("pos"), F.col("__value").alias("record"))
