"""Incremental rule scoring of prediction files (Structured Streaming).

The batch scorer (``operators.rules.score_outputs``) applied to a stream:
prediction JSON-lines files landing in a directory are read with
``readStream`` (schema given, one micro-batch per trigger), joined to the
static evaluation items (stream-static join, the items are broadcast only
when AQE finds them small) and scored with the same column expressions.
No state is kept across batches: each prediction is scored once, so a
restarted query with the same checkpoint location resumes exactly where it
stopped.  Running summaries are left to a batch job over the written rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chatsieve.operators.rules import score_outputs

PREDICTION_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("output", T.StringType()),
])


def prediction_stream(spark: SparkSession, directory: str, schema: T.StructType = PREDICTION_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(directory)


def score_stream(predictions: DataFrame, items: DataFrame, use_gold_category: bool = True,
                 key="id", categories=None) -> DataFrame:
    """Streaming scored rows: the per-item detail of ``score_outputs``."""
    return score_outputs(items, predictions, use_gold_category, key=key, categories=categories)


def start_scoring(spark: SparkSession, directory: str, items: DataFrame, sink_path: str,
                  checkpoint: str, use_gold_category: bool = True, trigger_once: bool = False):
    """Start a query writing scored predictions as JSON lines to ``sink_path``."""
    scored = score_stream(prediction_stream(spark, directory), items, use_gold_category)
    w = (scored.writeStream.format("json").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
