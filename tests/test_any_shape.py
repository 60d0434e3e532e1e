"""Schema-free logs and metrics against plain JSON, on the golden files and on odd records."""
import glob
import json
import os

from pyspark.sql import functions as F

from chatsieve.operators import any_shape as AS
from chatsieve.operators import runs as R
from chatsieve.sources import io as IO

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def plain_leaves(x, path=""):
    if isinstance(x, (dict, list)):
        items = x.items() if isinstance(x, dict) else enumerate(x)
        return [leaf for k, v in items for leaf in plain_leaves(v, f"{path}__{k}" if path else str(k))]
    return [(path, x)]


def test_leaves_of_odd_records(spark):
    records = ['{"a":{"b":1.5,"rewards/x":[1,{"z":2},[]],"e":{}},"s":"t","n":null,"ok":true,"step":3}', "[1,[2,[3]]]", "7",
               '"text"', "{}", "null", '{"k`<x>":{"é.y":-1e3}}', '{"big":123456789012345678}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*records, "bad{", None, ""])], "id int, j string")
    good, bad = AS.parse_records(df, "j")
    assert sorted((r["id"], r["j"]) for r in bad.collect()) == [(8, "bad{"), (9, None), (10, "")]
    got = sorted((r["id"], r["path"], r["value"]) for r in AS.flatten_records(good, "record", ["id"]).collect() if r["type"] != "VOID")

    def text(v):
        return str(v).lower() if isinstance(v, bool) else "-1000" if v == -1000 else str(v)
    want = sorted((i, p, text(v)) for i, r in enumerate(records) for p, v in plain_leaves(json.loads(r)) if v is not None)
    assert [(i, p) for i, p, _ in got] == [(i, p) for i, p, _ in want]
    assert [v if v != "-1000.0" else "-1000" for _, _, v in got] == [v for _, _, v in want]
    nulls = AS.flatten_records(good, "record", ["id"]).where("type = 'VOID'").collect()
    assert sorted((r["id"], r["path"], r["value"]) for r in nulls) == [(0, "n", None), (5, "", None)]
    assert AS.depth(good, "record") == 4 and AS.depth(good.where("id > 90"), "record") == 0
    assert AS.leaves(good.where("id > 90"), "record", ["id"]).count() == 0


def test_series_need_a_step_and_numbers(spark):
    rows = [(1, '{"step": 2, "loss": 0.5, "note": "x", "m": {"deep": {"er": 4}}}'), (1, '{"loss": 9}'), (2, '{"step": "4", "lr": 1e-5}'),
            (2, '{"step": null, "lr": 1}'), (2, '{"step": 5, "lr": null, "on": false}')]
    good, _ = AS.parse_records(spark.createDataFrame(rows, "run int, j string"), "j")
    got = sorted(map(tuple, AS.numeric_series(good, "record", ["run"]).collect()))
    assert got == [(1, 2.0, "loss", 0.5), (1, 2.0, "m__deep__er", 4.0), (2, 4.0, "lr", 1e-5)]


def test_trainer_logs_without_a_schema(spark):
    """The goldens' series come out alike with and without a schema and metric names."""
    pattern = f"{FIX}/logs/*/*/trainer_state.json"
    files, bad = AS.read_json_files(spark, pattern)
    assert files.count() == len(glob.glob(pattern)) > 0 and bad.count() == 0
    free = AS.numeric_series(AS.log_records(files), "record", ["run", "pos"])
    records = R.log_records(IO.read_trainer_logs(spark, pattern))
    numbers = [c for c, t in records.dtypes if c not in ("run", "pos", "step") and t in ("double", "bigint")]
    known = R.log_series(records, numbers).select("run", "pos", F.col("step").cast("double"), "series", "value")
    assert sorted(map(tuple, free.select("run", "pos", "step", "series", "value").collect())) == sorted(map(tuple, known.collect()))
    stats = {(r["run"], r["series"]): r["count"] for r in R.log_stats(free).collect()}
    assert {n for (_, s), n in stats.items() if s == "loss"} == {12, 50, 90}


def test_run_summaries_without_a_schema(spark):
    pattern = f"{FIX}/runs/*/*.json"
    files, _ = AS.read_json_files(spark, pattern)
    got = {}
    for r in AS.flatten_records(files, "record", ["run_name"]).collect():
        got.setdefault(r["run_name"], {})[r["path"]] = r["value"]
    for f in glob.glob(pattern):
        run = os.path.basename(os.path.dirname(f))
        want = plain_leaves(json.load(open(f, encoding="utf-8")))
        assert set(got[run]) == {p for p, _ in want}
        for path, v in want:
            x = got[run][path]
            assert x is None if v is None else float(x) == v if isinstance(v, (int, float)) and not isinstance(v, bool) \
                else x == (str(v).lower() if isinstance(v, bool) else v), path


def test_malformed_files_are_quarantined(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", '{"x": '), ("c", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.json").write_text(text)
    files, bad = AS.read_json_files(spark, f"{tmp_path}/*/s.json")
    assert [r["run_name"] for r in files.collect()] == ["a"]
    assert "b" in {r["run_name"] for r in bad.collect()}
