import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import keyword_index
from corpuscope.operators.keyword_index import KeywordIndex, add_to_index, indexed_filter, indexed_match, read_blocks, term_blocks
from corpuscope.operators.keywords import keyword_filter, keyword_match
from corpuscope.sources.artifacts import as_artifacts
from tests.conftest import plan, rows

RNG = random.Random(3)
WORDS = ["load", "loader", "Über", "naïve", "x", "ab", "日本語", "data_1", "100%", "the", "aaaa", "value"]


def artifacts(spark, count, start=0):
    """Texts of few words; every tenth row has a rare word, some no text, some a second one of its own."""
    made = []
    for i in range(start, start + count):
        text = " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(0, 12))) + (f" rare{i % 40}" if i % 10 == 0 else "")
        made.append((f"r{i % 3}", f"f{i}.py", None if i % 17 == 0 else text, text if i % 5 else "Second ONLY here", "m"))
    df = spark.createDataFrame(made, "repo_id string, file_path string, enhanced_content string, original_content string, rich_metadata string")
    cls = df.where("hash(file_path) % 2 = 0").withColumn("class_name", F.upper("file_path"))
    return {"file": as_artifacts(df, "file"), "class": as_artifacts(cls, "class")}


REQUESTS = [
    (1, ["rare0"], "all", None), (2, ["load", "the"], "files", "r1"), (3, ["LOAD", "load", "value"], "classes", None), (4, ["x"], "all", "r0"),
    (5, ["second only"], "all", None), (6, ["l%der"], "all", None), (7, ["%"], "files", None), (8, [""], "all", None), (9, ["語", "ab"], "all", None),
    (10, ["nowhere"], "all", None), (11, [], "all", None), (12, None, "all", None), (13, ["the"], "functions", None), (14, ["data_1"], "odd", "none"),
    (15, ["aa"], "all", None), (16, ["naïve", "nowhere at all"], "all", "r2"),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    index = KeywordIndex(str(tmp_path_factory.mktemp("index")), buckets=8, block_bytes=1500)
    levels = artifacts(spark, 300)
    levels = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in levels.items()}
    add_to_index(levels, index)
    return index, levels


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_match_equals_search_without_index(spark, built, literal, k):
    index, levels = built
    requests = spark.createDataFrame(REQUESTS, "query_id bigint, keywords array<string>, scope string, repo_id string")
    want = keyword_match(levels, requests, k, literal)
    assert rows(indexed_match(spark, index, requests, k, literal).select(want.columns)) == rows(want)


def test_filter_equals_and_reads_few_blocks(spark, built):
    index, levels = built
    for keywords, scope, literal in ((["rare0"], "all", False), (["l%der", "ab"], "files", False), (["100%"], "classes", True), (["%"], "all", False)):
        want = keyword_filter(levels, keywords, scope, literal)
        columns = [c for c in want.columns if c != "embedding"]
        assert rows(indexed_filter(spark, index, keywords, scope, literal).select(columns)) == rows(want.select(columns))
    every = read_blocks(spark, index).count()
    held = {t: n for t, n in term_blocks(spark, index, spark.createDataFrame([("rare0",), ("nowhere",), ("%",)], "term string")).groupBy(
        "term").count().collect()}
    assert held["rare0"] < every / 2 and "nowhere" not in held and held["%"] == every
    # Folders without a hit are not read, and nothing is a nested loop.
    text = plan(indexed_filter(spark, index, ["rare0"]))
    assert "dynamicpruning" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_bound_spares_blocks(spark, tmp_path, monkeypatch):
    """One dense block first: the others cannot reach its score and are not searched."""
    index = KeywordIndex(str(tmp_path / "i"), buckets=4, block_bytes=4000)
    made = [("r", f"f{i:03d}", ("word " * 1000 if i else "") + "needle", None, None) for i in range(40)]
    levels = {"file": as_artifacts(spark.createDataFrame(
        made, "repo_id string, file_path string, enhanced_content string, original_content string, rich_metadata string"), "file")}
    add_to_index(levels, index)
    read = []
    inner = keyword_index._read
    monkeypatch.setattr(keyword_index, "_read", lambda s, i, blocks: (read.append(blocks.count()), inner(s, i, blocks))[1])
    requests = spark.createDataFrame([(1, ["needle"], "all")], "query_id bigint, keywords array<string>, scope string")
    got = indexed_match(spark, index, requests, 1).collect()
    assert [r.file_path for r in got] == ["f000"] and got[0].relevance_score == 1.0
    assert read[0] == keyword_index.FIRST_BLOCKS and read[1] == 0 and read_blocks(spark, index).count() > 10


def test_added_in_parts_and_unfinished(spark, tmp_path, monkeypatch):
    index = KeywordIndex(str(tmp_path / "i"), buckets=4, block_bytes=2000)
    first, second = ({k: spark.createDataFrame(v.collect(), v.schema) for k, v in artifacts(spark, n, s).items()} for n, s in ((80, 0), (60, 100)))
    requests = spark.createDataFrame(REQUESTS, "query_id bigint, keywords array<string>, scope string, repo_id string")
    add_to_index(first, index)

    def fail(*_):
        raise OSError("lost")

    want = rows(keyword_match(first, requests, 5))
    with monkeypatch.context() as patch:
        # All but the last write: nothing of it is seen.
        patch.setattr("pyspark.sql.classic.dataframe.DataFrame.coalesce", fail)
        with pytest.raises(OSError):
            add_to_index(second, index)
    columns = keyword_match(first, requests, 5).columns
    assert rows(indexed_match(spark, index, requests, 5).select(columns)) == want
    add_to_index(second, index)
    both = {k: first[k].unionByName(second[k]) for k in first}
    assert rows(indexed_match(spark, index, requests, 5).select(columns)) == rows(keyword_match(both, requests, 5))
    empty = KeywordIndex(str(tmp_path / "e"), buckets=2)
    add_to_index({k: v.limit(0) for k, v in first.items()}, empty)
    assert indexed_match(spark, empty, requests, 5).count() == 0 and indexed_filter(spark, empty, ["x"]).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(keyword_index, "CHUNK", 7)
    text = "aab aab 語 aab".encode()
    long = dict(zip(*(x.tolist() for x in keyword_index._dense([(text, 4)]))))
    monkeypatch.setattr(keyword_index, "CHUNK", 1 << 20)
    assert long == dict(zip(*(x.tolist() for x in keyword_index._dense([(text, 4), (b"aab", 0), (b"", 0)]))))
    code = keyword_index._codes(np.frombuffer(b"aab", np.uint8), 3)[0]
    assert long[code] == 0.75


def test_no_text_moves_to_meet_the_number_of_its_blocks(spark, tmp_path):
    """The texts of a repository and level would all go to one task."""
    texts = spark.range(4000).selectExpr("concat('r', id % 2) as repo_id", "concat('f', id) as file_path", "repeat('word ', 20) as enhanced_content",
                                         "cast(null as string) as original_content", "'m' as rich_metadata")
    levels = {"file": as_artifacts(texts, "file")}
    index = KeywordIndex(str(tmp_path / "i"), block_bytes=100_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        placed = keyword_index._placed(keyword_index.all_levels(levels).select(*keyword_index.STORED), index, "b")
        text = plan(placed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8


def test_runs_of_a_block_and_shorter_pieces():
    texts = [b"aab aab", b"b", b"", b"\x00\x00\x00", "語ab".encode()]
    got = {}
    for _, owner, code, n in keyword_index._counts([np.frombuffer(t, np.uint8) for t in texts]):
        got |= {(int(o), int(c), _): int(k) for o, c, k in zip(owner, code, n)}
    want = {}
    for i, t in enumerate(texts):
        for w in (1, 2, 3):
            for at in range(len(t) - w + 1):
                key = (i, int.from_bytes(t[at:at + w], "big"), w)
                want[key] = want.get(key, 0) + 1
    assert got == want
