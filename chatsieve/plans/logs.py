"""Registered run-table and training-log queries (L1-L10, S10) on ``events``.

``events`` plays a training log: ``user_id`` is the run, ``event_id`` the
record position, ``ts`` the step and ``event_type`` the series; ``props``
holds nested JSON.  Run tables aggregate each user's events into one run row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatsieve.operators import any_shape as AS
from chatsieve.operators import runs as R
from chatsieve.plans.common import r6, register, table

TYPES = ["click", "error", "purchase", "signup", "view"]
RANK_MIN_EVENTS = 67


def epoch_micros(c: str):
    """Microseconds since 1970-01-01 of a timestamp without time zone (no
    dependence on the session time zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def records(spark, sf, prefix: str = ""):
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"),
                     epoch_micros("ts").alias("step"),
                     *[F.when(F.col("event_type") == t, F.col("value")).alias(prefix + t) for t in TYPES])


# ---------------------------------------------------------------- L5
def q_log_series(spark, sf):
    s = R.log_series(records(spark, sf), TYPES, "step")
    return s.select("run", "pos", "step", "series", "value")


register("log_series", """
SELECT user_id AS run, event_id AS pos, epoch_us(ts) AS step, event_type AS series, value
FROM events WHERE value IS NOT NULL""")(q_log_series)


# ---------------------------------------------------------------- L6
def q_log_stats(spark, sf):
    st = R.log_stats(R.log_series(records(spark, sf), TYPES, "step"))
    return st.select("run", "series", "count", r6(F.col("first")).alias("first"),
                     r6(F.col("last")).alias("last"), r6(F.col("min")).alias("min"))


register("log_stats", """
SELECT user_id AS run, event_type AS series, count(value) AS count,
       round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last,
       round(min(value), 6) AS min
FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type""")(q_log_stats)


# ---------------------------------------------------------------- L7
def q_reward_series(spark, sf):
    recs = records(spark, sf, prefix="rewards/")
    s = R.log_series(recs, [f"rewards/{t}" for t in TYPES], "step")
    return s.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("max_value"),
                                   F.max_by("step", "pos").alias("last_step"))


register("reward_series", """
SELECT 'rewards/' || event_type AS series, count(*) AS n, round(max(value), 6) AS max_value,
       arg_max(epoch_us(ts), event_id) AS last_step
FROM events WHERE value IS NOT NULL GROUP BY event_type""")(q_reward_series)


# ---------------------------------------------------------------- L8
def q_running_peak(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    p = R.running_peak(ev, ["user_id"], ["ts", "event_id"], "value", digits=4)
    return p.select("event_id", "user_id", "peak")


register("running_peak", """
SELECT event_id, user_id,
       round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS peak
FROM events""")(q_running_peak)


# ---------------------------------------------------------------- L9
def q_best_runs(spark, sf):
    ev = table(spark, sf, "events")
    per_run = ev.groupBy("event_type", "user_id").agg(F.avg("value").alias("score"))
    b = R.best_runs(per_run, "score", "user_id", k=2, ascending=False, by=["event_type"])
    return b.select("event_type", "user_id", "rank", r6(F.col("score")).alias("score"))


register("best_runs", """
SELECT event_type, user_id, rank, round(score, 6) AS score FROM (
  SELECT event_type, user_id, score,
         row_number() OVER (PARTITION BY event_type ORDER BY score DESC NULLS LAST, user_id) AS rank
  FROM (SELECT event_type, user_id, avg(value) AS score FROM events GROUP BY event_type, user_id))
WHERE rank <= 2""")(q_best_runs)


# ---------------------------------------------------------------- L2 / L3 / L4 / S10
def event_runs(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    agg = ev.groupBy("user_id").agg(
        F.min("event_type").alias("target_preset"), F.max("event_type").alias("quantization"),
        F.count(F.lit(1)).alias("n"), F.max(k).alias("kmax"),
        F.avg("value").alias("eval_loss"), (F.min("value") / F.max("value")).alias("eval_mean_token_accuracy"),
        F.sum("value").alias("train_runtime_seconds"), F.max("value").alias("max_memory_allocated_gb"))
    return agg.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("experiment"),
        "target_preset", "quantization", F.lit("fp16").alias("dtype"),
        F.when(F.col("n") >= RANK_MIN_EVENTS, F.col("kmax").cast("string")).otherwise(F.lit("auto")).alias("rank"),
        "eval_loss", "eval_mean_token_accuracy", "train_runtime_seconds", "max_memory_allocated_gb",
        F.concat(F.lit("runs/run_"), F.col("user_id").cast("string")).alias("path"))


def q_run_report(spark, sf):
    ordered = R.order_runs(event_runs(spark, sf))
    return R.markdown_rows(ordered).select("order", "line")


SQL_EVENT_RUNS = f"""r AS (
  SELECT 'run_' || user_id AS experiment, min(event_type) AS target_preset, max(event_type) AS quantization,
         'fp16' AS dtype,
         CASE WHEN count(*) >= {RANK_MIN_EVENTS} THEN CAST(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS VARCHAR)
              ELSE 'auto' END AS rank,
         avg(value) AS eval_loss, min(value) / max(value) AS eval_mean_token_accuracy,
         sum(value) AS train_runtime_seconds, max(value) AS max_memory_allocated_gb,
         'runs/run_' || user_id AS path
  FROM events GROUP BY user_id)"""

register("run_report", f"""WITH {SQL_EVENT_RUNS},
o AS (SELECT *, row_number() OVER (ORDER BY coalesce(quantization, ''), coalesce(target_preset, ''),
                                   coalesce(TRY_CAST(rank AS INTEGER), 999), path) AS ord FROM r)
SELECT CAST(ord AS BIGINT) AS "order",
       '| ' || experiment || ' | ' || target_preset || ' | ' || quantization || ' | ' || dtype || ' | ' || rank || ' | ' ||
       printf('%.4f', eval_loss) || ' | ' || printf('%.4f', eval_mean_token_accuracy) || ' | ' ||
       printf('%.4f', train_runtime_seconds) || ' | ' || printf('%.4f', max_memory_allocated_gb) || ' |' AS line
FROM o
UNION ALL SELECT -1, '| Experiment | Target | Quant | DType | r | Eval Loss | Eval Acc | Time(s) | Max Alloc GB |'
UNION ALL SELECT 0, '|---|---:|---:|---:|---:|---:|---:|---:|---:|'""")(q_run_report)


# ---------------------------------------------------------------- L1
PROPS_SCHEMA = "k INT, extra STRUCT<note: STRING>"


def q_get_nested(spark, sf):
    ev = table(spark, sf, "events").withColumn("p", F.from_json("props", PROPS_SCHEMA))
    return ev.select("event_id",
                     R.get_nested(ev, ["p", "k"], -1).alias("k"),
                     R.get_nested(ev, ["p", "extra", "note"], "none").alias("note"),
                     R.get_nested(ev, ["p", "absent"], "n/a").alias("absent"),
                     R.get_json_path("props", ["k"], "").alias("k_text"))


register("get_nested", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k,
       coalesce(json_extract_string(props, '$.extra.note'), 'none') AS note, 'n/a' AS absent,
       coalesce(json_extract_string(props, '$.k'), '') AS k_text
FROM events""")(q_get_nested)


# ---------------------------------------------------------------- L10
def q_flatten_metrics(spark, sf):
    ev = table(spark, sf, "events")
    nested = ev.select("event_id", F.struct(F.col("value"), F.get_json_object("props", "$.k").cast("int")
                                             .alias("k")).alias("eval_metrics"))
    flat = R.flatten_metrics(nested, ["eval_metrics"])
    return flat.select("event_id", F.col("eval_metrics__value").alias("eval_metrics__value"),
                       "eval_metrics__k")


register("flatten_metrics", """
SELECT event_id, value AS eval_metrics__value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS eval_metrics__k
FROM events""")(q_flatten_metrics)


# ---------------------------------------------------------------- S5 / S6 / L5 / L10 without a schema
def shaped_records(spark, sf):
    """A JSON record of each event whose fields differ by its type; every 97th is cut off, every 89th has no step."""
    ev = table(spark, sf, "events")
    kind, value, id_ = F.col("event_type"), F.col("value").cast("string"), F.col("event_id")
    metric = F.concat(F.lit('"'), kind, F.lit('":{"value":'), F.coalesce(value, F.lit("null")), F.lit(',"tags":["'), kind,
                      F.lit('",null,'), (id_ % 3).cast("string"), F.lit("]}"))
    step = F.when(id_ % 89 != 0, F.concat(F.lit('"step":'), id_.cast("string"), F.lit(","))).otherwise("")
    whole = F.concat(F.lit("{"), step, metric, F.lit(',"extra":'), F.coalesce("props", F.lit("{}")), F.lit("}"))
    text = F.when(id_ % 97 != 0, whole).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 1))
    return ev.select("event_id", F.col("user_id").alias("run"), text.alias("text"))


def q_shaped_series(spark, sf):
    records, _ = AS.parse_records(shaped_records(spark, sf), "text")
    s = AS.numeric_series(records, "record", ["run"])
    return s.groupBy("run", "series").agg(F.count(F.lit(1)).alias("n"), r6(F.min_by("value", "step")).alias("first"),
                                          r6(F.max_by("value", "step")).alias("last"), r6(F.min("value")).alias("min"))


SQL_SHAPED = """good AS (
  SELECT event_id, user_id AS run, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         event_id % 89 <> 0 AS stepped FROM events WHERE event_id % 97 <> 0)"""

register("shaped_series", f"""WITH {SQL_SHAPED},
s AS (SELECT run, event_id, event_type || '__value' AS series, value FROM good WHERE stepped
      UNION ALL SELECT run, event_id, event_type || '__tags__2', event_id % 3 FROM good WHERE stepped
      UNION ALL SELECT run, event_id, 'extra__k', k FROM good WHERE stepped)
SELECT run, series, count(*) AS n, round(CAST(arg_min(value, event_id) AS DOUBLE), 6) AS first,
       round(CAST(arg_max(value, event_id) AS DOUBLE), 6) AS last, round(CAST(min(value) AS DOUBLE), 6) AS min
FROM s GROUP BY run, series""")(q_shaped_series)


def q_shaped_fields(spark, sf):
    records, bad = AS.parse_records(shaped_records(spark, sf), "text")
    fields = AS.field_profile(records, "record").groupBy("path", F.when(F.col("type").isin(*AS.NUMBERS), "number")
                                                         .otherwise(F.lower("type")).alias("kind")).agg(F.sum("n").alias("n"))
    return fields.unionByName(bad.agg(F.lit("").alias("path"), F.lit("malformed").alias("kind"), F.count(F.lit(1)).alias("n")))


register("shaped_fields", f"""WITH {SQL_SHAPED}
SELECT event_type || '__value' AS path, 'number' AS kind, count(*) AS n FROM good GROUP BY ALL
UNION ALL SELECT event_type || '__tags__0', 'string', count(*) FROM good GROUP BY ALL
UNION ALL SELECT event_type || '__tags__1', 'void', count(*) FROM good GROUP BY ALL
UNION ALL SELECT event_type || '__tags__2', 'number', count(*) FROM good GROUP BY ALL
UNION ALL SELECT 'extra__k', 'number', count(*) FROM good GROUP BY ALL
UNION ALL SELECT 'step', 'number', count(*) FROM good WHERE stepped GROUP BY ALL
UNION ALL SELECT '', 'malformed', count(*) FROM events WHERE event_id % 97 = 0""")(q_shaped_fields)


# ---------------------------------------------------------------- L2 / S9 on parsed summaries
def event_summaries(spark, sf):
    """Each user's events as a run summary with the nested layout of the summary files."""
    r = event_runs(spark, sf)
    return r.select(
        F.when(F.col("rank") != "auto", F.col("experiment")).alias("experiment"),
        "target_preset", "quantization", "dtype", "rank", F.struct("eval_loss", F.col("eval_mean_token_accuracy")).alias("eval_metrics"),
        F.col("path").alias("run_dir"), F.regexp_extract("path", "([^/]+)$", 1).alias("run_name"))


def q_run_table(spark, sf):
    t = R.run_table(event_summaries(spark, sf))
    return R.as_text_columns(t.select("experiment", "target_preset", "target_modules", "quantization", "dtype", "rank",
                                      "lora_alpha", "path"))


register("run_table", f"""WITH {SQL_EVENT_RUNS}
SELECT CASE WHEN rank <> 'auto' THEN experiment ELSE regexp_extract(path, '([^/]+)$', 1) END AS experiment, target_preset,
       '' AS target_modules, quantization, dtype, rank, '' AS lora_alpha, path
FROM r""")(q_run_table)
