"""Measure how a hot key is spread over tasks, from Spark's event log.

usage: python tools/skew_probe.py [--rows N] [--out docs/SKEW_PROBE.md]

A fixture in which one key holds a third of all rows is processed by each
skew-safe operator and by the plain window it replaces.  The event log
(written to a fresh scratch folder) gives every task's shuffle records read;
the report shows, per job, the largest share of a stage's records that a
single task read.  A window partitioned by the hot key puts about a third of
the rows into one task; the operators here should stay near 1/partitions.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_path: str):
    files = sorted(p for p in glob.glob(f"{log_path}/**", recursive=True) if os.path.isfile(p)) \
        if os.path.isdir(log_path) else [log_path]
    for fp in files:
        with open(fp, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    yield json.loads(line)


def stage_shares(log_path: str) -> dict[int, float]:
    """job id -> max over its shuffle-reading stages of (max task records / stage records)."""
    stage_job, per_stage = {}, {}
    for ev in _events(log_path):
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerTaskEnd":
            m = ev.get("Task Metrics") or {}
            rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            if rd:
                per_stage.setdefault(ev["Stage ID"], []).append(rd)
    out = {}
    for sid, recs in per_stage.items():
        share = max(recs) / sum(recs)
        job = stage_job.get(sid, -1)
        out[job] = max(out.get(job, 0.0), share)
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--rows", type=int, default=300_000)
    ap.add_argument("--partitions", type=int, default=16)
    ap.add_argument("--out", default=None)
    args = ap.parse_args()

    scratch = tempfile.mkdtemp(prefix="skew-probe-")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from chatsieve.operators.clean import extract_qa_pairs, first_of_duplicates
    from chatsieve.operators.tokens import chat_fragments
    from chatsieve.operators.ranking import exact_row_number, running_max
    from chatsieve.session import ensure_checkpoint_dir, get_session

    spark = get_session("local[8]", shuffle_partitions=args.partitions, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{scratch}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    ensure_checkpoint_dir(spark, os.path.join(scratch, "ckpt"))
    n = args.rows
    # key 0 holds a third of the rows; the rest spread over 1000 keys
    df = spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"),
        (F.col("id") * 7919 % 100003).cast("double").alias("v"))

    # conversations: conversation 0 holds a third of all turns; turns are dense
    turns = spark.range(n).select(
        F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("conv_id"),
        F.col("id").alias("k"))
    turns = turns.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("k")) - 1)
                         .alias("turn")).checkpoint()
    turns = turns.select("conv_id", "turn",
                         F.when(F.col("turn") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
                         F.lit("text").alias("text"))

    cases = [
        ("row number per group: window", lambda: df.withColumn(
            "rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "k")))),
        ("row number per group: exact_row_number", lambda: exact_row_number(df, ["g"], ["v", "k"], "rn")),
        ("running max per group: window", lambda: df.withColumn(
            "m", F.max("v").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))),
        ("running max per group: running_max", lambda: running_max(df, ["g"], ["k"], "v", "m")),
        ("keep-first dedup: window", lambda: df.withColumn(
            "rn", F.row_number().over(Window.partitionBy("t").orderBy("k"))).where("rn = 1")),
        ("keep-first dedup: first_of_duplicates", lambda: first_of_duplicates(df, F.col("t"), "k")),
        ("question/answer pairing: lead() window", lambda: turns.withColumn(
            "next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))),
        ("question/answer pairing: extract_qa_pairs", lambda: extract_qa_pairs(turns)),
        ("chat fragments per turn: chat_fragments", lambda: chat_fragments(turns)),
        # last: turn automatic broadcasts off to see the sort-merge plan
        ("question/answer pairing: extract_qa_pairs, no broadcast", lambda: (
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"),
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"),
            extract_qa_pairs(turns))[-1]),
    ]
    results = []
    sc = spark.sparkContext
    for label, build in cases:
        sc.setJobGroup(label, label)
        build().write.format("noop").mode("overwrite").save()
        results.append(label)
    app_id = sc.applicationId
    spark.stop()
    logs = [p for p in glob.glob(f"{scratch}/*") if app_id in os.path.basename(p)]
    shares = stage_shares(logs[0])
    # attribute each job to the case (job group) that ran it
    job_case = {}
    for ev in _events(logs[0]):
        if ev.get("Event") == "SparkListenerJobStart":
            props = ev.get("Properties") or {}
            job_case[ev["Job ID"]] = props.get("spark.jobGroup.id", "?")
    worst = {}
    for job, share in shares.items():
        if not share:
            continue
        case = job_case.get(job, "?")
        worst[case] = max(worst.get(case, 0.0), share)
    lines = ["# Hot-key probe", "",
             f"{n} rows, one key holding a third of them, {args.partitions} shuffle partitions, "
             "local[8]. Largest share of a shuffle stage's records read by a single task "
             "(from the event log; 1/partitions = "
             f"{1 / args.partitions:.3f} is a perfect spread).", "",
             "| operator | largest single-task share |", "| --- | --- |"]
    for label in results:
        share = worst.get(label)
        lines.append(f"| {label} | {share:.3f} |" if share else f"| {label} | no shuffle read (broadcast join) |")
    text = "\n".join(lines) + "\n"
    if args.out:
        os.makedirs(os.path.dirname(args.out) or ".", exist_ok=True)
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
