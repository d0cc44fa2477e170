import random

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import negatives
from corpuscope.llm.negatives import hard_negatives

KIND = "vec_id bigint, label string, embedding array<bigint>, score int, anchor string"
LONG = (1 << 63) - 1


def brute(rows, positives=5, wanted=3):
    rows = [(i, label, v) for i, label, v, *_ in rows if label is not None and v is not None and None not in v]
    anchors = {(i, label, tuple(v)) for i, label, v in rows if i is not None and i % 5 == 0}
    out = []
    for i, label, v in anchors:
        def score(w):
            return max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(v, w))))

        def first(found, n):
            return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:n]

        same = first([(score(w), j) for j, other, w in rows if other == label and j != i], positives)
        rest = [(score(w), j) for j, other, w in rows if other != label]
        for p, j in same:
            inside = first([x for x in rest if 50 * p <= 100 * x[0] <= 95 * p], wanted)
            out += [(i, j, n, k, p, s) for n, (s, k) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def table(seed, n, values, width=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), [rng.randint(*values) for _ in range(width)], 1, "x") for i in range(n)]
    rows += [(None, "a", [values[1]] * width, 1, "x"), (n, None, [1] * width, 1, "x"), (n + 1, "b", None, 1, "x"),
             (n + 2, "c", [1, None] + [0] * (width - 2), 1, "x"), (n + 3, "b", [values[1]], 1, "x"), (n + 4, "a", [], 1, "x")]
    return rows + rows[:7] + [(5, "c", [values[1]] * width, 1, "x")]


@pytest.mark.parametrize("values", [(0, 2), (-256, 256), (-(1 << 31), 1 << 31), (-(1 << 62), 1 << 62)])
@pytest.mark.parametrize("at_once", [1 << 15, 4])
def test_equals_brute_force(spark, monkeypatch, values, at_once):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rows = table(2, 60, values)
    got = hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 5 == 0, anchors_at_once=at_once)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows) and (got or values[0])


def test_a_label_that_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 4 else "b", [rng.randint(0, 9) for _ in range(5)], 0, "") for i in range(400)]
    got = hard_negatives(spark.createDataFrame(rows, KIND).repartition(5), F.col("vec_id") % 5 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_tables(spark):
    empty = hard_negatives(spark.createDataFrame([], KIND), F.col("vec_id") % 5 == 0)
    assert empty.count() == 0 and empty.columns[0] == "anchor_id"
    lone = spark.createDataFrame([(0, "a", [1, 2], 0, "")], KIND)
    assert hard_negatives(lone, F.col("vec_id") % 5 == 0).count() == 0
