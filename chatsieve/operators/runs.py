"""Experiment-run tables and training logs (L1-L10, S9-S11 formatting).

Ordering and best-run ranks use the range-partitioned numbering of
``ranking`` (no single-task window even for very large run tables).
Training logs are exploded per record and aggregated per (run, series) with
partial aggregation; the running peak uses ``ranking.running_max``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve import defaults as D
from chatsieve.functions.format import fixed4, py_str
from chatsieve.operators.ranking import exact_row_number, running_max


def _has_path(schema: T.StructType, path: list[str]) -> bool:
    cur = schema
    for p in path:
        if not isinstance(cur, T.StructType) or p not in cur.fieldNames():
            return False
        cur = cur[p].dataType
    return True


# ---------------------------------------------------------------- L1
def get_nested(df: DataFrame, path: list[str], default=None) -> Column:
    """Value at a struct path, or ``default`` when the path is absent from the
    schema or the value is null."""
    if not _has_path(df.schema, path):
        return F.lit(default)
    col = F.col(".".join(f"`{p}`" for p in path))
    return col if default is None else F.coalesce(col, F.lit(default))


def get_json_path(c, path: list[str], default: str | None = None) -> Column:
    """Same for a JSON text column."""
    v = F.get_json_object(F.col(c) if isinstance(c, str) else c, "$." + ".".join(path))
    return v if default is None else F.coalesce(v, F.lit(default))


# ---------------------------------------------------------------- L2


def run_table(summaries: DataFrame, dir_col: str = "run_dir", dir_name_col: str = "run_name") -> DataFrame:
    """The 18-column run table: typed values (null when absent), the module
    list joined by commas, the run name falling back to the directory name."""
    cols = []
    for name, path in D.RUN_FIELDS:
        v = get_nested(summaries, path)
        if name == "experiment":
            v = F.coalesce(v, F.col(dir_name_col))
        if name == "target_modules":
            v = F.array_join(F.coalesce(v, F.array().cast("array<string>")), ",") \
                if _has_path(summaries.schema, path) else F.lit("")
        cols.append(v.alias(name))
    cols.append(F.col(dir_col).alias("path"))
    return summaries.select(*cols)


# ---------------------------------------------------------------- L3
def rank_key(c="rank", data_type: str = "string") -> Column:
    """Integer rank, 999 when it is none.  A number is cut to its whole part;
    a text must be an integer's."""
    number = data_type in ("double", "float") or data_type.startswith("decimal")
    value = F.col(c) if number else F.col(c).cast("string")
    return F.coalesce(value.try_cast("int"), F.lit(D.RANK_FALLBACK))


def order_runs(runs: DataFrame, out: str = "order") -> DataFrame:
    """Sort key (quantization, target preset, rank) with the path as final
    tie-break (files are read in sorted path order), numbered 1..n.

    The numbering is the range-partitioned ``exact_row_number``, so a run
    table with very many rows is never sorted in a single task.
    """
    keyed = runs.withColumn("__q", F.coalesce(F.col("quantization").cast("string"), F.lit(""))) \
        .withColumn("__t", F.coalesce(F.col("target_preset").cast("string"), F.lit(""))) \
        .withColumn("__r", rank_key("rank", dict(runs.dtypes)["rank"]))
    return exact_row_number(keyed, [], ["__q", "__t", "__r", "path"], out).drop("__q", "__t", "__r")


# ---------------------------------------------------------------- L4 / S9 / S10
def as_text_columns(df: DataFrame, columns=None) -> DataFrame:
    """Every value as Python would print it (CSV cells)."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    return df.select(*[py_str(F.col(f"`{c}`"), types[c]).alias(c) for c in columns])


def markdown_rows(runs: DataFrame, order_col: str = "order") -> DataFrame:
    """(order, line) Markdown table lines; floats with 4 decimals.  Header
    lines get orders -1 and 0."""
    types = dict(runs.dtypes)
    cells = ["experiment", "target_preset", "quantization", "dtype", "rank", "eval_loss",
             "eval_mean_token_accuracy", "train_runtime_seconds", "max_memory_allocated_gb"]
    parts = []
    for c in cells:
        f = fixed4(F.col(c), types[c]) if c in ("eval_loss", "eval_mean_token_accuracy",
                                                 "train_runtime_seconds", "max_memory_allocated_gb") \
            else py_str(F.col(c), types[c])
        parts.append(f)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    body = runs.select(F.col(order_col).cast("long").alias("order"), line.alias("line"))
    spark = runs.sparkSession
    header = spark.createDataFrame([(-1, D.RUN_TABLE_MD_HEADER[0]), (0, D.RUN_TABLE_MD_HEADER[1])],
                                   "order long, line string")
    return header.unionByName(body)


# ---------------------------------------------------------------- S11
def side_by_side_markdown(pairs: DataFrame, id_col: str = "id", title: str = D.SIDE_BY_SIDE_TITLE) -> DataFrame:
    """(order, block) Markdown sections: question, base answer, candidate answer.

    Writing the blocks in order, each followed by a newline, reproduces the
    report file.
    """
    before_id, after_id = D.SIDE_BY_SIDE_ITEM.split("{id}")
    between, after_cat = after_id.split("{category}")
    item_head = F.concat(F.lit(before_id), F.col(id_col).cast("string"), F.lit(between), F.col("category"),
                         F.lit(after_cat))
    block = F.concat(item_head, F.lit("\n\n" + D.SIDE_BY_SIDE_QUESTION + "\n\n"), F.col("question"),
                     F.lit("\n\n" + D.SIDE_BY_SIDE_BASE + "\n\n"), F.col("base_answer"),
                     F.lit("\n\n" + D.SIDE_BY_SIDE_CANDIDATE + "\n\n"), F.col("lora_answer"),
                     F.lit("\n\n---\n"))
    body = pairs.select(F.col(id_col).cast("long").alias("order"), block.alias("block"))
    head = pairs.sparkSession.createDataFrame([(-(2 ** 62), title + "\n")], "order long, block string")
    return head.unionByName(body)


# ---------------------------------------------------------------- L5 / L6 / L7
def log_records(logs: DataFrame, keep=("run",)) -> DataFrame:
    """One row per ``log_history`` entry with its list position."""
    keep = [k for k in keep if k in logs.columns]
    ex = logs.select(*keep, F.posexplode("log_history").alias("pos", "rec"))
    return ex.select(*keep, "pos", "rec.*")


def log_series(records: DataFrame, metrics: list[str], step: str = "step", keep=("run",)) -> DataFrame:
    """Long (series, pos, step, value) rows: records with a step, one row per
    metric present.  Metric names may contain '/' (reward series)."""
    keep = [k for k in keep if k in records.columns]
    present = [m for m in metrics if m in records.columns]
    if not present:
        raise ValueError(f"none of {metrics} in the log")
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("series"), F.col(f"`{m}`").cast("double").alias("value")) for m in present]))
    pos = F.col("pos") if "pos" in records.columns else F.lit(None).cast("long")
    s = records.where(F.col(step).isNotNull()).select(*keep, pos.alias("pos"), F.col(step).alias("step"),
                                                       stacked.alias("__s"))
    return s.select(*keep, "pos", "step", "__s.series", "__s.value").where(F.col("value").isNotNull())


def log_stats(series: DataFrame, by=("run", "series"), order: str = "pos") -> DataFrame:
    """Count, first, last and minimum of every series (first/last by ``order``)."""
    by = [b for b in by if b in series.columns]
    return series.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.min_by("value", F.col(order)).alias("first"),
        F.max_by("value", F.col(order)).alias("last"),
        F.min("value").alias("min"))


def reward_series(records: DataFrame, step: str = "step", keep=("run",)) -> DataFrame:
    return log_series(records, D.REWARD_METRICS, step, keep)


# ---------------------------------------------------------------- L8
def running_peak(df: DataFrame, by: list[str], order: list[str], value: str, scale: float = 1.0,
                 digits: int = 4, out: str = "peak") -> DataFrame:
    """Running maximum (optionally scaled, e.g. bytes -> GB) rounded to ``digits``."""
    r = running_max(df, by, order, value, "__peak")
    return r.withColumn(out, F.round(F.col("__peak") / F.lit(scale), digits)).drop("__peak")


# ---------------------------------------------------------------- L9
def best_runs(metrics: DataFrame, metric_col: str, run_col: str, k: int = 2, ascending: bool = True,
              by=()) -> DataFrame:
    """The ``k`` best runs per group by a metric (ties by run name).

    Each task keeps its own best k of a group before the shuffle (Spark's
    window group limit), so a group with very many runs is k rows a task."""
    o = F.col(metric_col).asc_nulls_last() if ascending else F.col(metric_col).desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(o, F.col(run_col))
    return metrics.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


# ---------------------------------------------------------------- L10
def flatten_metrics(df: DataFrame, struct_cols=("train_metrics", "eval_metrics"), sep: str = "__") -> DataFrame:
    """Nested metric structs to top-level columns named ``<struct><sep><field>``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in struct_cols and isinstance(types[c], T.StructType):
            for f in types[c].fieldNames():
                out.append(F.col(f"`{c}`.`{f}`").alias(f"{c}{sep}{f}"))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)
