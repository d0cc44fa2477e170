import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.llm.quality import Rules, STATISTICS, fit_quality, fit_rules, keep_good, lasso_logistic, quality_scores, rule_matrix, statistics

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(score) + 0.5


def test_statistics_of_plain_cases():
    got = statistics(pa.array([None, "", "a a a a", "AB, cd\nAB, cd\nx1!", "é" * 9]))
    at = {n: i for i, n in enumerate(STATISTICS)}
    assert not got[0].any() and not got[1].any()
    assert got[2, at["top_word"]] == 1 and got[2, at["same_as_before"]] == 0.75
    assert got[3, at["repeated_lines"]] == pytest.approx(1 / 3) and got[3, at["upper_share"]] == pytest.approx(4 / 9)
    assert got[4, at["wide_share"]] == 1 and np.isfinite(got).all()


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = fit_rules(x[:2000], y[:2000])
    z = model.intercept + rule_matrix(x[2000:], model.rules) @ np.array(model.weights)
    assert auc(z, y[2000:]) > 0.98 and 0 < len(model.rules) < 200
    assert fit_rules(x[:2000], y[:2000]) == model


def test_lasso_drops_noise():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (2000, 30)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * a[:, 0] - 3 * a[:, 1])))).astype(float)
    w, _ = lasso_logistic(a, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and np.count_nonzero(w) <= 6


def test_one_label_or_none():
    x = np.zeros((4, 5))
    assert fit_rules(x[:0], np.zeros(0)).rules == () and fit_rules(x, np.ones(4)).intercept > 1 and fit_rules(x, np.zeros(4)).intercept < -1


def test_columns_equal_numpy_and_names(spark):
    texts = [None, "", "One two three.", "A! B! C!", "x " * 5000, "é漢 | 1 | 2"]
    model = Rules((((0, True, 1.0),), ((5, False, 0.01), (8, True, 0.0))), (0.7, -1.3), 0.2)
    kind = "doc_id bigint, text string, stats string, score string, row int"
    df = spark.createDataFrame([(i, t, "s", "c", i) for i, t in enumerate(texts)], kind)
    got = quality_scores(df, model)
    assert got.columns == [*df.columns, "_score"]
    values = {r.doc_id: r._score for r in got.collect()}
    want = 1 / (1 + np.exp(-(model.intercept + rule_matrix(statistics(pa.array(texts)), model.rules) @ np.array(model.weights))))
    assert np.allclose([values[i] for i in range(len(texts))], want)
    kept = keep_good(df, model, 0.6)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, v in enumerate(want) if v >= 0.6}
    assert quality_scores(df.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = labels.collect()
    learn = spark.createDataFrame([r for r in rows if not held(r.doc_id)], labels.schema)
    model = fit_quality(docs, learn.unionByName(learn.limit(1).withColumn("quality", F.lit(None).cast("int"))))
    score = {r.doc_id: r.score for r in quality_scores(docs.select("doc_id", "text"), model).collect()}
    test = [r for r in rows if held(r.doc_id)]
    s, y = np.array([score[r.doc_id] for r in test]), np.array([r.quality for r in test])
    assert auc(s, y) > 0.95 and (s[y == 1] >= 0.3).mean() > 0.95 and (s[y == 0] < 0.3).mean() > 0.6
    assert fit_quality(docs.limit(0), labels).rules == ()
