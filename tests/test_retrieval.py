import math
import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import matching
from corpuscope.operators.keywords import extract_terms, keyword_filter, keyword_match, keyword_rank, metadata_search, name_lookup
from corpuscope.operators.merge import best_per_file, candidate_cards, hybrid_merge, rerank
from corpuscope.operators.vectors import to_results, vector_search, vector_topk, with_content
from corpuscope.plans.search import REQUEST_SCHEMA, hybrid_search, routed_search
from corpuscope.sources.artifacts import KEYS, as_artifacts, focus_level, scope_level
from tests.conftest import plan, rows

RNG = random.Random(7)


def make_levels(spark, n=40, dim=4):
    def vector(i):
        # A third of all rows are copies of one vector.
        return [1.0, 0.0, 0.0, 0.5] if i % 3 == 0 else [RNG.uniform(-1, 1) for _ in range(dim)]

    data = {
        level: [
            (f"repo{i % 2}", f"src/{level}_{i % 7}.py", f"{level} load_{i} Loader", f"def load_{i} data  loader\tx" * (i % 4), vector(i) if i % 5 else None)
            for i in range(n)
        ]
        for level in ("file", "class", "function")
    }
    out = {}
    for level, items in data.items():
        name = {"file": "file_path", "class": "class_name", "function": "function_name"}[level]
        if level == "file":
            items = [(r, f"{p}{i}", c, v) for i, (r, p, _, c, v) in enumerate(items)]
            schema = "repo_id string, file_path string, enhanced_content string, embedding array<float>"
        else:
            schema = f"repo_id string, file_path string, {name} string, enhanced_content string, embedding array<float>"
        out[level] = as_artifacts(spark.createDataFrame(items, schema), level)
    return out


def brute_topk(found, query, k, repo=None, level="all"):
    order = {"file": 1, "class": 2, "function": 3}

    def distance(v):
        dot, norms = sum(a * b for a, b in zip(v, query)), math.sqrt(sum(a * a for a in v) * sum(b * b for b in query))
        return round(1 - dot / norms, 9) + 0.0 if norms else math.inf

    scored = [(distance(r.embedding), order[r.type], r.file_path, r.name, r.parent_class, r.repo_id, r.position) for r in found
              if r.embedding is not None and repo in (None, r.repo_id) and level in ("all", r.type)]
    return sorted(scored)[:k]


def query_frame(spark, data):
    return spark.createDataFrame(data, "query_id bigint, repo_id string, level string, embedding array<double>")


def check_topk(spark, levels, data, k, **how):
    got = vector_search(levels, query_frame(spark, data), k, **how).orderBy("query_id", "rank").collect()
    found = [r for df in levels.values() for r in df.collect()]
    for q, repo, level, v in data:
        want = brute_topk(found, v, k, repo, level or "all")
        mine = [r for r in got if r.query_id == q]
        assert [w[2:] for w in want] == [(r.file_path, r.name, r.parent_class, r.repo_id, r.position) for r in mine]
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all(math.isnan(r.distance) if math.isinf(w[0]) else abs(w[0] - r.distance) < 1e-6 for w, r in zip(want, mine))


@pytest.mark.parametrize("how", [{}, {"queries_at_once": 3}])
def test_vector_search_is_exact(spark, how):
    """Many ties, repositories, levels and a query of length zero."""
    levels = make_levels(spark)
    data = [(i, None, None, [RNG.uniform(-1, 1) for _ in range(4)]) for i in range(3)]
    data += [(9, None, "file", [1.0, 0.0, 0.0, 0.5]), (10, "repo1", "all", [1.0, 0.0, 0.0, 0.5]), (11, "repo0", "class", [0.1, 1.0, 0.0, 0.0]),
             (12, "nowhere", "all", [1.0, 0.0, 0.0, 0.0]), (13, None, "all", [0.0] * 4)]
    check_topk(spark, levels, data, 12, **how)


def test_zero_vectors_come_last(spark):
    rng = random.Random(4)
    for n in (3, 8, 40):
        items = [("r", f"p{i}", [0.0, 0.0] if rng.random() < 0.4 else [rng.choice([-1.0, 1.0, 2.0]), rng.choice([0.0, 1.0])]) for i in range(n)]
        df = as_artifacts(spark.createDataFrame(items, "repo_id string, file_path string, embedding array<float>"), "file")
        check_topk(spark, {"file": df}, [(1, None, None, [1.0, 0.5])], 6)


def test_equal_names_in_one_file(spark):
    """Two methods of one name in classes of one file, two overloads, and the same paths in two repositories keep their own text."""
    items = [(repo, "src/a.py", "__init__", cls, line, f"{repo} {cls} {line}", [1.0, float(line)])
             for repo in ("r1", "r2") for cls, line in (("A", 1), ("B", 2), ("B", 3))]
    df = as_artifacts(spark.createDataFrame(items, "repo_id string, file_path string, function_name string, parent_class string, "
                                                   "position int, enhanced_content string, embedding array<float>"), "function")
    hits = vector_search({"function": df}, query_frame(spark, [(1, None, None, [1.0, 0.0]), (2, "r2", None, [1.0, 0.0])]), 10)
    got = to_results(with_content(hits, df, ["enhanced_content"])).collect()
    assert len([r for r in got if r.query_id == 1]) == 6 and len([r for r in got if r.query_id == 2]) == 3
    assert all(r.enhanced_content == f"{r.repo_id} {r.parent_class} {r.position}" for r in got)
    again = with_content(hits, df.unionByName(df), ["enhanced_content"])
    assert again.count() == 9


def test_wrong_dimension_fails(spark):
    df = as_artifacts(spark.createDataFrame([("p", [1.0, 2.0])], "file_path string, embedding array<float>"), "file")
    with pytest.raises(Exception, match="3 dimensions"):
        vector_topk(df, query_frame(spark, [(1, None, None, [1.0, 2.0, 3.0])]), 1).collect()


def test_no_queries_or_vectors(spark):
    levels = make_levels(spark)
    assert vector_search(levels, query_frame(spark, []), 5).count() == 0
    assert vector_search(levels, query_frame(spark, [(1, None, None, None)]), 5).count() == 0
    assert metadata_search(levels, spark.createDataFrame([], "query_id bigint, pos bigint, term string"), 5).collect() == []


def test_results_carry_score_and_content(spark):
    levels = make_levels(spark)
    hits = vector_search(levels, query_frame(spark, [(1, None, "file", [1.0, 0.0, 0.0, 0.5])]), 4)
    shaped = to_results(with_content(hits, levels["file"], ["enhanced_content"]))
    assert shaped.count() == 4
    assert all(abs(r.relevance_score - 1) < 1e-9 and r.parent_class == "" for r in shaped.collect())


TEXTS = ["Find the Loader, and load_data!", "  Éenai,\xa0über  x² naïve ", "", "the of", "a\x1cb ccc\u2003ddd …eee…"]
TERMS = [["find", "loader", "load_data"], ["éenai", "über", "naïve"], [], [], ["ccc", "ddd", "eee"]]


def test_terms(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    got = {}
    for r in extract_terms(df, "text", ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.term)
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == TERMS[i]


def test_keyword_score(spark):
    texts = ["Load the load of LOADS", "", "aaaa", "tab\tand\nnew\u2003line load", None, "İstanbul load"]
    df = as_artifacts(spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "file_path string, enhanced_content string"), "file")
    got = {r.file_path: r.relevance_score for r in keyword_rank(df, ["Load", "aa"], None).collect()}
    # Hits of "load" and "aa" per word, two keywords, one percent: 3/5, 0, 2/1, 1/4, 0 and 1/2, all above the density.
    assert got == {"p0": 1.0, "p1": 0.0, "p2": 1.0, "p3": 1.0, "p4": 0.0, "p5": 1.0}
    long = df.withColumn("enhanced_content", F.lit("load " + "w " * 199)).limit(1)
    assert abs(keyword_rank(long, ["Load", "aa"], None).first().relevance_score - 1 / (200 * 2 * 0.01)) < 1e-12


def keyed(spark, data):
    return spark.createDataFrame(data, "query_id bigint, keywords array<string>, scope string, repo_id string")


def test_keyword_search_over_scopes(spark):
    levels = make_levels(spark)
    one = keyword_filter(levels, ["load_1", "nothing"], "classes")
    assert {r.type for r in one.collect()} == {"class"}
    asked = keyed(spark, [(1, ["load_1"], "all", None), (2, ["LOAD_2"], "functions", None), (3, ["data"], "other", None), (4, [], "all", None),
                          (5, ["load%"], "all", "repo1"), (6, None, "all", None)])
    many = keyword_match(levels, asked, 5)
    got = many.collect()
    assert {r.type for r in got if r.query_id == 2} == {"function"}
    assert {r.type for r in got if r.query_id == 3} == {"file"}
    assert {r.repo_id for r in got if r.query_id == 5} == {"repo1"} and not any(r.query_id in (4, 6) for r in got)
    single = keyword_rank(keyword_filter(levels, ["load_1"], "all"), ["load_1"], 5)
    columns = [*KEYS, "relevance_score", "enhanced_content", "match_reason"]
    assert rows(many.where("query_id = 1"), *columns) == rows(single, *columns)


def named(spark, data):
    return spark.createDataFrame(data, "query_id bigint, level string, names string, repo_id string")


def test_underscore_is_a_wildcard_unless_literal(spark):
    df = spark.createDataFrame([("a", "loadXdata"), ("b", "LOAD_DATA")], "file_path string, class_name string")
    levels = {"class": as_artifacts(df, "class")}
    assert len(rows(name_lookup(levels, named(spark, [(1, "class", "load_data, zzz", None)])))) == 2
    assert len(rows(name_lookup(levels, named(spark, [(1, "class", "load_data", None)]), literal=True))) == 1
    assert name_lookup(levels, named(spark, [(1, "module", "load", None), (2, "class", "load", "other")])).count() == 0


def asked_terms(spark, data):
    flat = [(q, i, t, repo) for q, repo, terms in data for i, t in enumerate(terms)]
    return spark.createDataFrame(flat, "query_id bigint, pos bigint, term string, repo_id string")


def test_metadata_search_keeps_first_term_and_limits(spark, monkeypatch):
    levels = make_levels(spark)
    asked = asked_terms(spark, [(1, None, ["load_1", "loader"]), (2, None, ["file"]), (3, "repo1", ["loader"])])
    got = metadata_search(levels, asked, 6).orderBy("query_id", "rank").collect()
    first = [r for r in got if r.query_id == 1]
    assert len(first) == 6 and {r.type for r in first} == {"function"} and {r.score for r in first} == {0.95}
    assert {r.repo_id for r in got if r.query_id == 3} == {"repo1"}
    monkeypatch.setattr(matching, "TERMS_AT_ONCE", 1)
    again = metadata_search(levels, asked, 6).orderBy("query_id", "rank").collect()
    assert got == again


def test_plans_do_not_grow_with_the_requests(spark):
    """Five thousand requests have the plan, the scans and the results of ten."""
    levels = make_levels(spark)
    sizes = []
    for n in (10, 5000):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit(0).cast("bigint").alias("pos"),
                                      F.concat(F.lit("load_"), F.col("id") % 40).alias("term"))
        found = metadata_search(levels, asked, 3)
        sizes.append((len(plan(found).splitlines()), plan(found).count("Scan")))
    assert sizes[0] == sizes[1]
    got = {q: sorted(x) for q, x in found.groupBy("query_id").agg(F.collect_list("name").alias("x")).collect()}
    assert len(got) == 5000 and all(got[q] == got[q % 40] for q in got)


def keyed_by(df):
    """Rows of one repository without parents or positions."""
    return df.withColumns({"repo_id": F.lit("r"), "parent_class": F.lit(""), "position": F.lit(0).cast("bigint")})


def result(spark, data):
    return keyed_by(spark.createDataFrame(
        data, "query_id bigint, rank bigint, file_path string, name string, type string, relevance_score double, match_reason string"))


def test_rerank_order_range_and_fallback(spark):
    cands = result(spark, [(q, i + 1, f"f{i}", f"n{i}", "file", 0.5, "") for q in (1, 2, 3) for i in range(10)])
    ranks = spark.createDataFrame([(1, 0, 7, 9.5, "best"), (1, 1, 99, 9.0, "out"), (1, 2, 0, 8.0, "next"), (3, 0, 50, 9.0, "out")],
                                  "query_id bigint, pos bigint, index bigint, relevance double, reason string")
    got = rerank(cands, ranks)
    one = got.where("query_id = 1").orderBy("rank").collect()
    assert [(r.file_path, r.relevance_score, r.match_reason) for r in one] == [("f7", 0.95, "best"), ("f0", 0.8, "next")]
    assert got.where("query_id = 2").count() == 8
    assert got.where("query_id = 3").count() == 0
    assert [r.file_path for r in rerank(cands, ranks, min_relevance=9.0).where("query_id = 1").collect()] == ["f7"]


def test_cards(spark):
    df = result(spark, [(1, 1, "f", "n", "file", 0.12345, "")]).withColumn("enhanced_content", F.repeat(F.lit("x"), F.lit(151)))
    row = candidate_cards(df).first()
    assert row["index"] == 0 and row.base_score == 0.123 and row.description == "x" * 150 + "..."


def test_hybrid_merge_prefers_metadata_on_equal_score(spark):
    meta = keyed_by(spark.createDataFrame([(1, 1, "a", "a", "file", 0.85), (1, 2, "b", "b", "file", 0.85), (1, 3, "c", "c", "class", 0.9)],
                                          "query_id bigint, rank bigint, file_path string, name string, type string, score double"))
    vec = result(spark, [(1, 1, "a", "a", "file", 0.96, ""), (1, 2, "b", "b", "file", 0.95, ""), (1, 3, "d", "d", "file", 0.99, "")])
    merged = {r.name: (round(r.relevance_score, 3), r.origin) for r in hybrid_merge(meta, vec).collect()}
    assert merged == {"a": (0.96, "vector"), "b": (0.95, "metadata"), "c": (1.0, "metadata"), "d": (0.99, "vector")}
    best = best_per_file(hybrid_merge(meta, vec), 2).orderBy("rank").collect()
    assert [r.name for r in best] == ["c", "d"]


def search_requests(spark, data):
    """Requests from (id, tool, other columns)."""
    columns = [c.split(" ")[0] for c in REQUEST_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"request_id": i, "tool": tool, **rest}.get(c) for c in columns) for i, tool, rest in data], REQUEST_SCHEMA)


VECTOR = [1.0, 0.0, 0.0, 0.5]


def test_hybrid_and_routed(spark):
    levels = make_levels(spark)
    ranks = spark.createDataFrame([(1, 0, 2, 9.0, "x")], "query_id bigint, pos bigint, index bigint, relevance double, reason string")
    data = [(1, "hybrid_search", {"text": "the load_3 thing", "embedding": VECTOR}),
            (5, "x", {"text": "of", "embedding": VECTOR, "focus": "classes", "repo_id": "repo1"}),
            (2, "identify_file", {"level": "class", "names": "load_1"}), (3, "keyword_match", {"keywords": ["data"], "scope": "files"})]
    found = hybrid_search(levels, search_requests(spark, data[:2]), ranks, 10).collect()
    one = [r for r in found if r.query_id == 1]
    assert len({(r.repo_id, r.file_path) for r in one}) == len(one) <= 10 and one
    assert {(r.type, r.repo_id) for r in found if r.query_id == 5} == {("class", "repo1")}
    texts = {(r.type, *[r[k] for k in KEYS]): r.enhanced_content for df in levels.values() for r in df.collect()}
    assert all(r.enhanced_content == texts[(r.type, *[r[k] for k in KEYS])] for r in found)
    routed = routed_search(levels, search_requests(spark, data), ranks)
    assert {(r.tool, r.query_id) for r in routed.collect()} == {("hybrid_search", 1), ("hybrid_search", 5), ("identify_file", 2), ("keyword_match", 3)}
    assert {"repo_id", "file_path", "name", "type", "relevance_score", "enhanced_content", "parent_class", "match_reason", "rich_metadata"} <= set(routed.columns)
    words_ = spark.createDataFrame([("classes",), ("nonsense",), (None,)], "w string").select(focus_level("w").alias("f"), scope_level("w").alias("s"))
    assert [tuple(r) for r in words_.collect()] == [("class", "class"), ("all", "file"), ("all", "file")]


def test_search_plans(spark):
    levels = make_levels(spark)
    ranks = spark.createDataFrame([(1, 0, 2, 9.0, "x")], "query_id bigint, pos bigint, index bigint, relevance double, reason string")
    text = plan(hybrid_search(levels, search_requests(spark, [(1, "h", {"text": "load", "embedding": VECTOR})]), ranks, 10))
    assert text.count("MapInArrow") == 2, "vectors and names are read once"
    assert "WindowGroupLimit" in text and "NestedLoop" not in text and "Cartesian" not in text
    asked = keyed(spark, [(1, ["load%", "a", "%"], "all", None)])
    for df in (keyword_match(levels, asked), name_lookup(levels, named(spark, [(1, "class", "lo_d, a", None)])),
               metadata_search(levels, asked_terms(spark, [(1, None, ["l%d", "ab"])]))):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df) and plan(df).count("MapInArrow") == 1
    routed = plan(routed_search(levels, search_requests(spark, [(1, "h", {"text": "load", "embedding": VECTOR})]), ranks))
    assert "NestedLoop" not in routed and routed.count("MapInArrow") == 1
    top = plan(keyword_rank(keyword_filter(levels, ["load"]), ["load"], 5))
    assert "TakeOrderedAndProject" in top and "Join" not in top
