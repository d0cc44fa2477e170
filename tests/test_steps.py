import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpuscope.plans.steps import batch_steps, check_steps, resolve_tables, run_steps
from corpuscope.session import release, shared_dir, staged
from corpuscope.sources.artifacts import as_artifacts, read_artifacts, write_artifacts
from corpuscope.sources.ledger import append_ledger, read_ledger
from corpuscope.sources.tree import read_config, scan_sources, write_sources
from tests.conftest import plan, rows

SCORES = [(1, "Alice", 95), (2, "Bob", 88), (3, "Charlie", 76)]


def scores(spark):
    return spark.createDataFrame(SCORES, "c_id int, name string, score int")


def test_sample_flow(spark, tmp_path, capsys):
    steps = [
        {"op": "derive", "name": "passed_flag", "input": "scores", "column": "passed", "expression": "score > 80"},
        {"op": "filter", "name": "only", "input": "passed_flag", "condition": "passed"},
        {"op": "custom_sql", "name": "n", "sql": "SELECT count(*) AS n FROM only"},
        {"op": "join", "name": "back", "left": "only", "right": "scores", "on": "c_id", "how": "anti"},
        {"op": "write", "input": "passed_flag", "format": "stdout", "columns": ["c_id", "passed"]},
        {"op": "write", "input": "passed_flag", "format": "json", "path": str(tmp_path / "o"), "columns": ["c_id", "name", "score", "passed"]},
    ]
    frames = run_steps(spark, steps, {"scores": scores(spark)})
    assert [r.passed for r in frames["passed_flag"].orderBy("c_id").collect()] == [True, True, False]
    assert frames["n"].first().n == 2 and frames["back"].count() == 0
    read = run_steps(spark, [{"op": "read", "name": "r", "path": str(tmp_path / "o"), "format": "json"}])["r"]
    assert read.count() == 3 and set(read.columns) == {"c_id", "name", "score", "passed"}


def test_bad_steps(spark):
    with pytest.raises(ValueError, match="unknown operation"):
        run_steps(spark, [{"op": "drop"}])
    with pytest.raises(ValueError, match="missing condition"):
        run_steps(spark, [{"op": "filter", "input": "x"}])


def test_filter_reaches_the_scan(spark, tmp_path):
    scores(spark).write.parquet(str(tmp_path / "p"))
    out = run_steps(spark, [
        {"op": "read", "name": "s", "path": str(tmp_path / "p"), "format": "parquet"},
        {"op": "derive", "name": "d", "input": "s", "column": "passed", "expression": "score > 80"},
        {"op": "filter", "name": "f", "input": "d", "condition": "c_id > 1"},
        {"op": "custom_sql", "name": "q", "sql": "SELECT c_id, passed FROM f"},
    ])["q"]
    assert "GreaterThan(c_id,1)" in plan(out) and "name" not in plan(out).split("ReadSchema")[1].split(">")[0]


def test_checks(spark):
    steps = spark.createDataFrame(
        [(1, 0, "read", {"path": "p"}), (1, 1, "filter", {"input": "a", "condition": " "}), (1, 2, "zip", {}), (2, 0, "custom_sql", {"sql": "x"}),
         (3, 0, "custom_sql", None)],
        "config_id int, pos int, op string, params map<string,string>")
    assert rows(check_steps(steps)) == [(1, 0, "read", "missing format"), (1, 1, "filter", "missing condition"), (1, 2, "zip", "unknown operation"),
                                       (3, 0, "custom_sql", "missing sql")]
    assert "Join" not in plan(check_steps(steps))
    assert [r.batch for r in batch_steps(spark.range(25).select((F.col("id") * 700).alias("pos"), F.lit(1).alias("config_id"))).orderBy("pos").collect()] == [i // 10 for i in range(25)]
    known = spark.createDataFrame([("example",)], "table_name string")
    asked = spark.createDataFrame([("example",), ("other",)], "table_name string")
    assert rows(resolve_tables(asked, known)) == [("example", "./examples/example.json")]


def test_source_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "sub/b.js": "é", "sub/c.txt": "no", "node_modules/d.py": "no", ".git/e.py": "no", "venv/f.py": "no",
                       "big.py": "y" * 100, "g.pyx": "no", "sub/deep/h.rs": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    got = {r.name: r for r in scan_sources(spark, str(tmp_path), max_bytes=50).collect()}
    assert sorted(got) == ["a.py", "b.js", "bad.py", "big.py", "h.rs"]
    assert got["a.py"].content == "x = 1\n" and got["a.py"].is_python and got["b.js"].extension == ".js" and got["b.js"].size == 2
    assert got["big.py"].content is None and got["big.py"].size == 100 and got["bad.py"].content is None
    write_sources(scan_sources(spark, str(tmp_path), [".js"]), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().content == "é"


def test_config(spark, tmp_path):
    doc = {"data_sources": [{"name": "s", "type": "file", "connection_params": {"path": "p"}, "tables_or_files": ["in_memory"]}],
           "outputs": [{"name": "o", "format": "stdout", "schema": {"columns": ["c_id", "passed"]}}], "processing_config": {"batch_size": 100},
           "validation": {"is_valid": True}, "sequence": [{"op": "read", "path": "x"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    row = read_config(spark, str(tmp_path)).first()
    assert row.data_sources[0].connection_params["path"] == "p" and row.outputs[0].schema.columns == ["c_id", "passed"]
    assert row.processing_config.batch_size == 100 and row.sequence == [{"op": "read", "path": "x"}]


def test_ledger(spark, tmp_path):
    when = dt.datetime(2024, 5, 6, 7, 8, 9, 120)
    runs = spark.createDataFrame([("u1", True, when, "s"), ("u1", False, when, "s"), (None, True, dt.datetime(2024, 1, 1), "t")],
                                 "user_id string, code_validator_success boolean, saved_at timestamp, stage string")
    append_ledger(runs, str(tmp_path / "l"))
    append_ledger(runs, str(tmp_path / "l"))
    got = read_ledger(spark, str(tmp_path / "l"))
    assert got.count() == 4 and {r.user_id for r in got.collect()} == {"u1", "default_user"}
    one = read_ledger(spark, str(tmp_path / "l"), "u1")
    first = one.first()
    assert (first.timestamp, first.saved_at, first.validation_status) == ("20240506_070809", "2024-05-06T07:08:09.000120", "PASSED")
    assert json.loads(first.bot_state)["stage"] == "s" and "PartitionFilters: [isnotnull(user_id" in plan(one)


def test_artifact_store(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a", "f", "C", [1.0]), ("r2", "b", "g", "D", None)],
                               "repo_id string, file_path string, function_name string, parent_class string, embedding array<float>")
    write_artifacts(as_artifacts(df, "function"), str(tmp_path), "function")
    got = read_artifacts(spark, str(tmp_path), "function", "r2")
    assert rows(got, "repo_id", "type", "name", "parent_class") == [("r2", "function", "g", "D")]
    assert "PartitionFilters: [isnotnull(repo_id" in plan(got)
    with pytest.raises(ValueError):
        read_artifacts(spark, str(tmp_path), "module")


def test_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    made = shared_dir(spark, "x")
    assert root is None or made.startswith(root)
    table = staged(spark.range(3), "x")
    assert table.count() == 3
    release(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.staged_at)


def test_no_shared_folder_on_a_cluster():
    """Only a local master may fall back to a temporary folder."""
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context), "x")
