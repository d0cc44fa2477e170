import random
from collections import defaultdict

from corpuscope.llm.exact import drop_duplicates, duplicate_groups, heavy_digests

ROWS = [(1, "a", 0), (2, "a", 1), (2, "a", 2), (3, None, 3), (4, "", 4), (5, "A", 5), (6, "a ", 6), (None, "a", 7),
        (None, "lone", 8), (None, "lone", 9), (7, "é" * 5000, 10), (8, "é" * 5000, 11)]
KIND = "doc_id bigint, text string, digest int"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep))
    return sorted(out, key=repr)


def test_groups(spark):
    for heavy in (1, 2, 1024):
        got = duplicate_groups(spark.createDataFrame(ROWS, KIND), heavy=heavy)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr) == brute(ROWS)


def test_empty_and_clashing_names(spark):
    kind = "doc_id bigint, text string, digest int, kept_id string, again int, keep_id int"
    empty = spark.createDataFrame([], kind)
    assert duplicate_groups(empty).count() == 0 and drop_duplicates(empty).columns == empty.columns
    rows = [(i, t, n, "x", n, n) for i, t, n in ROWS]
    kept = drop_duplicates(spark.createDataFrame(rows, kind))
    assert kept.columns == empty.columns
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(
        [(2, "a"), (4, ""), (5, "A"), (6, "a "), (None, "lone"), (8, "é" * 5000)], key=repr)
    assert all(r.kept_id == "x" and r.keep_id == r.digest for r in got)


def test_heavy_digests_are_found(spark):
    rng = random.Random(1)
    keys = ["hot"] * 400 + ["warm"] * 200 + [f"k{rng.randrange(10**9)}" for _ in range(600)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(bytearray(k, "utf8"),) for k in keys], "digest binary").repartition(7)
    found = {bytes(r.digest).decode() for r in heavy_digests(df, 8).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 8


def test_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", 0) for i in range(3000)]
    got = duplicate_groups(spark.createDataFrame(rows, KIND).repartition(9))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr) == brute(rows)
