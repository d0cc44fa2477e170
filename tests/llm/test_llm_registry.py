"""Registered operator queries against their SQL on the smallest tables, and the pipeline against a plain reading of its stages."""

import importlib
import math
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from check import compare, duck
from corpuscope.llm.queries import QUERIES, quality_model
from corpuscope.llm.quality import quality_scores
from tests.llm.test_llm_decontaminate import brute as brute_hits
from tests.llm.test_llm_mixing import brute_targets, size
from tests.llm.test_llm_ngram import brute as brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_all_registered():
    names = set(driver.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and {*QUERIES, "pipeline"} <= names
    assert {"op3_mix_sources", "op4_ngram_join", "op5_decontaminate", "op6_exact_dedup"} <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in QUERIES.items() if text))
def test_query_equals_sql(spark, name):
    outcome = compare(name, QUERIES[name][0](spark, SF), duck(SF), QUERIES[name][1])
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


@pytest.mark.parametrize("name", ["op2_quality", "op7_urls", "op8_toxicity", "op9_personal_data", "op10_lm_scores"])
def test_one_row_for_each_row(spark, name):
    source = "pages" if name == "op7_urls" else "documents"
    key = "page_id" if name == "op7_urls" else "doc_id"
    got = [r[0] for r in QUERIES[name][0](spark, SF).select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in quality_scores(docs, quality_model(docs, spark, SF)).collect()}
    left = {i: r for i, r in left.items() if scores[i] >= 0.3}
    last = {}
    for i, r in left.items():
        last[r.text] = max(i, last.get(r.text, i))
    left = {i: r for i, r in left.items() if last[r.text] == i}
    left = {i: left[i] for i, _, c in brute_groups([(i, r.text) for i, r in left.items()]) if i == c}
    hits = {h[0] for h in brute_hits([(i, r.text) for i, r in left.items()], benchmark) if h[2]}
    left = {i: r for i, r in left.items() if i not in hits}
    sizes = Counter()
    for r in left.values():
        sizes[r.source] += size(r.text)
    target = brute_targets(dict(sizes))

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy"]
    rows = out.collect()
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(left) and all(tuple(r)[:5] == tuple(left[r.doc_id]) for r in rows)
    taken = Counter()
    for i, r in left.items():
        rate = target[r.source] / sizes[r.source]
        assert math.floor(rate) <= copies[i] <= math.ceil(rate)
        taken[r.source] += copies[i] * size(r.text)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(size(r.text) for r in left.values() if r.source == s)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(importlib.import_module("corpuscope").__file__))
    for folder in ("corpuscope", "workload", "tests"):
        for where, _, names in os.walk(os.path.join(root, folder)):
            if f"{os.sep}llm" in where:
                continue
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"corpuscope[./]llm|from corpuscope import llm", open(os.path.join(where, n)).read()), n
