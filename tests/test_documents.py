import json

import pytest

from corpuscope.plans.documents import custom_step, plan_documents, run_documents
from corpuscope.sources.tree import read_config
from pyspark.sql import functions as F
from tests.conftest import rows


def source(name, path=""):
    return {"name": name, "type": "file", "connection_params": {"path": path}, "tables_or_files": ["in_memory"]}


def step(name, inputs, target=None, kind="custom", **parameters):
    return {"name": name, "type": kind, "parameters": parameters, "input_sources": inputs, "output_target": target}


def documents(spark, folder, *docs):
    for i, d in enumerate(docs):
        (folder / f"doc={i}").mkdir(parents=True)
        (folder / f"doc={i}" / "config.json").write_text(json.dumps(d))
    return read_config(spark, str(folder)).withColumn("doc", F.col("doc").cast("int"))


def test_layers_and_problems(spark, tmp_path):
    docs = documents(
        spark, tmp_path,
        {"data_sources": [source("a"), source("b")], "outputs": [{"name": "o"}],
         "transformations": [step("late", ["x", "y"], "z"), step("one", ["a"], "x"), step("two", ["x", "b"], "y")]},
        {"data_sources": [source("a")], "transformations": [step("p", ["q"]), step("q", ["p"]), step("r", ["a"]), step("s", ["nothing", "a"]), step("t", ["s"])]},
        {"data_sources": [source("a"), source("a")], "outputs": [{"name": "o"}]},
        {"outputs": [{"name": "o"}]})
    got = {(r.doc, r.name, r.pos): (r.layer, r.problem) for r in plan_documents(docs, "doc").collect()}
    assert got == {
        (0, "a", 0): (0, None), (0, "b", 1): (0, None), (0, "one", 1): (1, None), (0, "two", 2): (2, None), (0, "late", 0): (3, None),
        (0, "o", 0): (3, None),
        (1, "a", 0): (0, None), (1, "p", 0): (None, "cycle"), (1, "q", 1): (None, "cycle"), (1, "r", 2): (1, None),
        (1, "s", 3): (None, "unknown input: nothing"), (1, "t", 4): (None, "waits for: s"),
        (2, "a", 0): (0, None), (2, "a", 1): (0, "made twice"), (2, "o", 0): (1, None), (3, "o", 0): (0, None)}


def test_run(spark, tmp_path):
    """A document of the shape users keep: an in-memory source, one new column, and an output with a list of columns."""
    spark.createDataFrame([(1, "x", 80), (2, "y", 81)], "c_id int, name string, score int").write.parquet(str(tmp_path / "scores"))
    out = {"name": "o", "type": "file", "format": "parquet", "location": str(tmp_path / "out"), "schema": {"columns": ["c_id", "passed"]}}
    logic = "df['passed'] = df['score'] > 80"
    docs = documents(
        spark, tmp_path / "docs",
        {"data_sources": [source("given")], "transformations": [step("mark", ["given"], "flag", logic=logic)], "outputs": [{**out, "format": "stdout", "location": ""}]},
        {"data_sources": [source("s", str(tmp_path / "scores"))],
         "transformations": [step("more", ["flag"], "kept", "filter", condition="passed"), step("mark", ["s"], "flag", logic=logic)], "outputs": [out]},
        {"data_sources": [source("s", "nowhere")], "processing_config": {"error_handling": "continue"},
         "transformations": [step("bad", ["s"], kind="dance")]},
        {"data_sources": [], "transformations": [step("m", ["nothing"], logic=logic)]})
    given = spark.createDataFrame([(7, "z", 100)], "c_id int, name string, score int")
    done = run_documents(spark, docs.where("doc <> 2"), "doc", {"given": given})
    assert set(done) == {0, 1} and rows(done[0]["flag"], "passed") == [(True,)]
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, False), (2, True)]
    assert rows(done[1]["kept"], "c_id") == [(2,)]
    assert set(run_documents(spark, docs.where("doc = 2"), "doc", {"s": given})) == set()


def test_custom_logic():
    assert custom_step("df['a'] = df['b'] == df[\"c\"] + 1") == {"op": "derive", "column": "a", "expression": "`b` = `c` + 1"}
    for bad in ("df = df.dropna()", "df['a'] == 1", None, "import os"):
        with pytest.raises(ValueError):
            custom_step(bad)
