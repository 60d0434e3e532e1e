"""Line numbers, ordered parts and the JSON-lines quarantine on files of many splits."""
import csv
import glob
import json
import random

import pytest

from chatsieve.operators import metrics as M
from chatsieve.sources import io as IO


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_lines_of_many_splits_keep_their_places(spark, tmp_path, small_splits):
    rnd = random.Random(2)
    files = {n: [rnd.choice(["", "  ", "　", f"line {i} " + "é" * rnd.randrange(40)]) for i in range(k)]
             for n, k in (("b.txt", 300), ("a.txt", 170), ("c.txt", 1))}
    for n, lines in files.items():
        (tmp_path / n).write_text("\n".join(lines) + ("\n" if n == "a.txt" else ""), encoding="utf-8")
    got = sorted((r["pos"], r["text"]) for r in IO.read_ordered_lines(spark, str(tmp_path), start=1).collect())
    kept = [x.strip() for n in sorted(files) for x in files[n] if x.strip()]
    assert got == list(enumerate(kept, 1))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    numbered = IO.numbered_lines(spark, str(tmp_path), per_file=True).collect()
    for n, lines in files.items():
        own = sorted((r["pos"], r["value"]) for r in numbered if r["file"].endswith(n))
        assert own == list(enumerate(lines if lines[-1] or n == "a.txt" else lines[:-1]))
    assert IO.read_ordered_lines(spark, str(tmp_path / "c.txt")).count() == len([x for x in files["c.txt"] if x.strip()])


def test_ordered_parts_are_one_file(spark, tmp_path, small_splits):
    rows = [(i, None if i % 7 == 0 else f'say "{i}", ok', "" if i % 5 else f"x{i}") for i in random.Random(1).sample(range(2000), 2000)]
    df = spark.createDataFrame(rows, "n long, note string, tag string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        IO.write_lines(IO.csv_lines(df.withColumn("order", df["n"]), "order"), f"{tmp_path}/csv")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/csv/part-*")) > 2
    back = list(csv.reader(whole(f"{tmp_path}/csv").splitlines()))
    assert back == [["n", "note", "tag"], *([str(a), b or "", c] for a, b, c in sorted(rows, key=lambda r: r[0]))]
    parts = {r["part"]: (r["n_lines"], r["n_bytes"]) for r in IO.manifest(spark, f"{tmp_path}/csv").collect()}
    assert sum(n for n, _ in parts.values()) == 2001
    assert sum(b for _, b in parts.values()) == len(whole(f"{tmp_path}/csv").encode())
    lines = IO.read_ordered_lines(spark, f"{tmp_path}/csv", text_col="other")
    assert M.positional_align(lines, IO.read_ordered_lines(spark, f"{tmp_path}/csv"), "pos").where("other <> text").count() == 0


def test_quarantine_names_file_and_line(spark, tmp_path, small_splits):
    want, bad = [], []
    for name in ("x.jsonl", "y.jsonl"):
        lines = []
        for i in range(150):
            if i % 10 == 3:
                lines.append("")
            lines.append('{"id": %d, "t": ' % i if i % 17 == 0 else "[1" if i % 31 == 0 else json.dumps({"id": i, "t": "好" * (i % 9)}))
            (bad if i % 17 == 0 or i % 31 == 0 else want).append((name, len(lines), *((lines[-1],) if i % 17 == 0 or i % 31 == 0 else
                                                                                      (i, "好" * (i % 9)))))
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    rows, quarantine = IO.read_located_jsonl(spark, str(tmp_path), "id long, t string")
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["id"], r["t"]) for r in rows.collect()) == sorted(want)
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in quarantine.collect()) == sorted(bad)
