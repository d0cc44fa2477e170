"""Registered retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators.keyword_index import KeywordIndex, add_to_index, indexed_filter, indexed_match
from corpuscope.operators.keywords import (
    extract_terms,
    keyword_filter,
    keyword_match,
    keyword_rank,
    metadata_search,
    name_lookup,
)
from corpuscope.operators.merge import best_per_file, candidate_cards, hybrid_merge, rerank
from corpuscope.operators.vectors import to_results, vector_search, vector_topk, with_content
from corpuscope.plans.search import hybrid_search, routed_search
from corpuscope.session import shared_dir
from corpuscope.sources.artifacts import focus_level, read_artifacts, write_artifacts
from workload.tables import (
    CTES,
    class_artifacts,
    file_artifacts,
    function_artifacts,
    label_centroids,
    levels,
    rankings,
    sql,
    table,
    text_levels,
)

KEYWORDS = ["the", "tion", "ring"]

KEYS = "repo_id, type, file_path, parent_class, name, position"
TIES = "level, file_path, name, parent_class, repo_id, position"


def requests(spark, sf):
    """A search request for every benchmark item: its text, a centroid as its vector, and a tool, scope and repository by number."""
    items = table(spark, sf, "benchmark")
    number = F.col("item_id")

    def pick(by, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    terms = extract_terms(items, "text", ["item_id"]).where("pos < 2").groupBy(F.col("item_id").alias("t_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("keywords"))
    vectors = label_centroids(spark, sf).select(F.col("query_id").alias("label"), "embedding")
    return items.join(terms, number == F.col("t_id"), "left").join(vectors, number % 10 == F.col("label"), "left").select(
        number.alias("request_id"),
        F.when(number % 3 > 0, F.concat(F.lit("repo"), number % 5)).alias("repo_id"),
        pick(number, ["hybrid_search", "keyword_match", "identify_file", "unknown_tool"]).alias("tool"),
        "text", "embedding",
        pick(number, ["all", "files", "classes", "functions", "nonsense"]).alias("focus"),
        pick(number, ["file", "class", "function"]).alias("level"),
        F.concat(F.lit("src"), number % 20, F.lit("/, thth , small ring")).alias("names"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        pick(F.floor(number / 4), ["all", "files", "classes", "functions", "other"]).alias("scope"),
    )


STOP = "('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by')"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD_LIST = rf"regexp_extract_all({{0}}, '[^\s\x0b\x1c-\x1f\x85\p{{{{Z}}}}]+')"


def word_list(column):
    return WORD_LIST.format(column)


CTES["item_terms"] = rf"""
    SELECT item_id, (generate_subscripts(kept, 1) - 1)::BIGINT AS pos, unnest(kept) AS term FROM (
        SELECT item_id, list_filter(
            list_transform({word_list('lower(text)').replace('{{', '{').replace('}}', '}')},
                           lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')),
            lambda w: length(w) > 2 AND w NOT IN {STOP}) AS kept
        FROM benchmark)
"""
CTES["requests"] = """
    SELECT item_id AS request_id, CASE WHEN item_id % 3 > 0 THEN 'repo' || (item_id % 5) END AS repo_id,
           ['hybrid_search', 'keyword_match', 'identify_file', 'unknown_tool'][item_id % 4 + 1] AS tool, text, q AS embedding,
           ['all', 'file', 'class', 'function', 'all'][item_id % 5 + 1] AS focus_level,
           ['file', 'class', 'function'][item_id % 3 + 1] AS level, 'src' || (item_id % 20) || '/, thth , small ring' AS names,
           keywords, ['all', 'file', 'class', 'function', 'file'][(item_id // 4) % 5 + 1] AS scope_level
    FROM benchmark LEFT JOIN query_vectors ON query_id = item_id % 10
    LEFT JOIN (SELECT item_id AS t_id, list(term ORDER BY pos) AS keywords FROM item_terms WHERE pos < 2 GROUP BY item_id) ON t_id = item_id
"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return q(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def artifact_scan(spark, sf):
    root = shared_dir(spark, "artifacts")
    for level, df in levels(spark, sf).items():
        write_artifacts(df, root, level)
    out = None
    for level in ("file", "class", "function"):
        rows = read_artifacts(spark, root, level, repo_id="repo2").select(
            "repo_id", "type", "file_path", "name",
            F.coalesce("parent_class", F.lit("")).alias("parent_class"),
            F.length("original_content").cast("bigint").alias("chars"),
            F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("dims"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("dims", F.greatest("dims", F.lit(0)))


ARTIFACT_SCAN = sql("""
    SELECT repo_id, type, file_path, name, parent_class, length(content)::BIGINT AS chars,
           coalesce(len(embedding), 0)::BIGINT AS dims
    FROM artifacts WHERE repo_id = 'repo2'
""")


def vector_topk_file(spark, sf):
    hits = vector_topk(file_artifacts(spark, sf), label_centroids(spark, sf), 20)
    return hits.select("query_id", "rank", "file_path", F.round("distance", 6).alias("distance"))


VECTOR_TOPK_FILE = sql("""
    SELECT query_id, rank, file_path, round(distance, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, level, file_path, name, parent_class, repo_id, position) AS rank
        FROM near WHERE type = 'file')
    WHERE rank <= 20
""")


def vector_search_all(spark, sf):
    hits = vector_search(levels(spark, sf), label_centroids(spark, sf), 20)
    return hits.select("query_id", "rank", "repo_id", "type", "file_path", "name", "position", F.round("distance", 6).alias("distance"))


CTES["vector_hits"] = f"""
    SELECT query_id, rank, {KEYS}, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {TIES}) AS rank FROM near)
    WHERE rank <= 20
"""
VECTOR_SEARCH_ALL = sql("""
    SELECT query_id, rank, repo_id, type, file_path, name, position, round(distance, 6) AS distance FROM vector_hits
""")


def functions_near(spark, sf):
    return label_centroids(spark, sf).withColumn("level", F.lit("function"))


def similarity_results(spark, sf):
    hits = vector_search(levels(spark, sf), functions_near(spark, sf), 20)
    shaped = to_results(with_content(hits, text_levels(spark, sf)["function"], ["enhanced_content", "rich_metadata"]))
    return shaped.withColumn("relevance_score", F.round("relevance_score", 6))


SIMILARITY_RESULTS = sql(f"""
    SELECT query_id, rank, n.repo_id, n.type, n.file_path, n.parent_class, n.name, n.position, round(1 - distance, 6) AS relevance_score,
           content AS enhanced_content, '' AS match_reason, rich_metadata
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {TIES}) AS rank FROM near WHERE type = 'function') n
    JOIN artifacts a ON a.type = n.type AND a.position = n.position
    WHERE rank <= 20
""")


def name_lookup_requests(spark, sf):
    return name_lookup(text_levels(spark, sf), requests(spark, sf).withColumnRenamed("request_id", "query_id"))


def ilikes(column, names):
    return " OR ".join(f"{column} ILIKE {q('%' + n.strip() + '%')}" for n in names)


SAME_REPO = "(r.repo_id IS NULL OR r.repo_id = a.repo_id)"
CTES["named_hits"] = f"""
    SELECT request_id AS query_id, r.tool, a.*, 'Exact ' || r.level || ' match: ' || names AS match_reason
    FROM requests r JOIN artifacts a ON a.type = r.level AND {SAME_REPO}
    WHERE len(list_filter(string_split(names, ','), lambda n: a.name ILIKE '%' || trim(n) || '%')) > 0
"""
NAME_LOOKUP_REQUESTS = sql(f"""
    SELECT query_id, {KEYS}, 1.0::DOUBLE AS relevance_score, content AS enhanced_content, match_reason, rich_metadata FROM named_hits
""")


def request_terms(spark, sf):
    asked = requests(spark, sf).withColumnRenamed("request_id", "query_id")
    return extract_terms(asked, "text", ["query_id", "repo_id"])


def metadata_search_terms(spark, sf):
    return metadata_search(text_levels(spark, sf), request_terms(spark, sf), 10)


CTES["term_hits"] = f"""
    SELECT request_id AS query_id, pos AS term_pos, {KEYS.replace("repo_id", "a.repo_id").replace(" type", " a.type")},
           CASE a.type WHEN 'function' THEN 1 WHEN 'class' THEN 2 ELSE 3 END AS branch,
           CASE a.type WHEN 'function' THEN 0.95::DOUBLE WHEN 'class' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS score
    FROM requests r JOIN item_terms ON item_id = request_id JOIN artifacts a ON {SAME_REPO} AND contains(lower(a.name), term)
"""
BY_NAME = "name, file_path, parent_class, repo_id, position"
CTES["meta_hits"] = f"""
    SELECT query_id, rank, {KEYS}, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term_pos, branch, {BY_NAME}) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, {KEYS} ORDER BY term_pos) AS seen FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, term_pos, type ORDER BY {BY_NAME}) AS in_branch
                FROM term_hits) WHERE in_branch <= 10) WHERE seen = 1) WHERE rank <= 10
"""
METADATA_SEARCH_TERMS = sql("SELECT * FROM meta_hits")


def query_terms(spark, sf):
    return extract_terms(table(spark, sf, "benchmark"), "text", ["item_id"])


QUERY_TERMS = sql("SELECT * FROM item_terms")


def keyword_filter_all(spark, sf):
    hits = keyword_filter(text_levels(spark, sf), KEYWORDS, "all")
    return hits.select("repo_id", "type", "file_path", "name", "position", "rich_metadata")


def keyword_filter_files(spark, sf):
    hits = keyword_filter(text_levels(spark, sf), ["tion", "ein_"], "files")
    return hits.select("repo_id", "type", "file_path", "name")


KEYWORD_FILTER_ALL = sql(f"""
    SELECT repo_id, type, file_path, name, position, rich_metadata FROM artifacts WHERE {ilikes('content', KEYWORDS)}
""")
KEYWORD_FILTER_FILES = sql(f"""
    SELECT repo_id, type, file_path, name FROM artifacts WHERE type = 'file' AND ({ilikes('content', ['tion', 'ein_'])})
""")


def relevance_sql(content, keywords):
    hits = " + ".join(
        f"(length(lower({content})) - length(replace(lower({content}), {q(k)}, ''))) // {len(k)}" for k in keywords
    )
    n = f"len({word_list(content).replace('{{', '{').replace('}}', '}')})"
    return f"CASE WHEN {n} > 0 THEN least(({hits}) / ({n} * {len(keywords)} * 0.01::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


def keyword_relevance_all(spark, sf):
    """Every hit with its score, not only the best ones."""
    hits = keyword_filter(text_levels(spark, sf), ["the", "ring"], "all")
    return keyword_rank(hits, ["the", "ring"], None).withColumn("relevance_score", F.round("relevance_score", 6))


KEYWORD_RELEVANCE_ALL = sql(f"""
    SELECT {KEYS}, content AS enhanced_content, rich_metadata, round({relevance_sql('content', ['the', 'ring'])}, 6) AS relevance_score,
           'Keyword matches: the, ring' AS match_reason
    FROM artifacts WHERE {ilikes('content', ['the', 'ring'])}
""")


def keyword_top(spark, sf):
    hits = keyword_filter(text_levels(spark, sf), ["tion", "ung"], "all")
    return keyword_rank(hits, ["tion", "ung"], 20).withColumn("relevance_score", F.round("relevance_score", 6))


KEYWORD_TOP = sql(f"""
    SELECT {KEYS}, content AS enhanced_content, rich_metadata, round(s, 6) AS relevance_score, 'Keyword matches: tion, ung' AS match_reason FROM (
        SELECT *, {relevance_sql('content', ['tion', 'ung'])} AS s FROM artifacts WHERE {ilikes('content', ['tion', 'ung'])})
    ORDER BY s DESC, file_path, level, name, parent_class, repo_id, position LIMIT 20
""")


def vector_candidates(spark, sf):
    return to_results(vector_search(levels(spark, sf), label_centroids(spark, sf), 20))


def rerank_labels(spark, sf):
    ranked = rerank(vector_candidates(spark, sf), rankings(spark, sf))
    return ranked.select("query_id", "rank", "repo_id", "type", "file_path", "name", "position",
                         F.round("relevance_score", 6).alias("relevance_score"), "match_reason")


def reranked_sql(hits):
    return f"""
    SELECT query_id, rank, {KEYS}, relevance_score, match_reason FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, {KEYS}) AS rank FROM (
            SELECT r.query_id, pos, {KEYS}, relevance / 10.0::DOUBLE AS relevance_score, reason AS match_reason
            FROM rankings r JOIN {hits} v ON v.query_id = r.query_id AND v.rank - 1 = r.idx
            UNION ALL
            SELECT query_id, rank - 1, {KEYS}, 1 - distance, '' FROM {hits}
            WHERE rank <= 8 AND query_id NOT IN (SELECT query_id FROM rankings)))
    WHERE rank <= 8
"""


CTES["reranked"] = reranked_sql("vector_hits")
RERANK_LABELS = sql("""
    SELECT query_id, rank, repo_id, type, file_path, name, position, round(relevance_score, 6) AS relevance_score, match_reason FROM reranked
""")


def candidate_descriptions(spark, sf):
    files = label_centroids(spark, sf).withColumn("level", F.lit("file"))
    hits = vector_search(levels(spark, sf), files, 20)
    shaped = to_results(with_content(hits, text_levels(spark, sf)["file"], ["enhanced_content"]))
    return candidate_cards(shaped).select("query_id", "index", "repo_id", "file_path", "base_score", "description")


CANDIDATE_DESCRIPTIONS = sql(f"""
    SELECT query_id, rank - 1 AS index, n.repo_id, n.file_path, round(1 - distance, 3) AS base_score,
           CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS description
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {TIES}) AS rank FROM near WHERE type = 'file') n
    JOIN artifacts a ON a.type = 'file' AND a.file_path = n.file_path
    WHERE rank <= 20
""")

# Vector hits of the requests, each in its repository and level.
CTES["request_vectors"] = f"""
    SELECT query_id, rank, {KEYS}, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {TIES}) AS rank FROM (
            SELECT r.request_id AS query_id, n.* EXCLUDE (query_id) FROM requests r JOIN near n ON n.query_id = r.request_id % 10
            AND (r.repo_id IS NULL OR r.repo_id = n.repo_id) AND r.focus_level IN ('all', n.type)))
    WHERE rank <= 20
"""
CTES["request_ranked"] = reranked_sql("request_vectors")
CTES["merged"] = f"""
    SELECT query_id, {KEYS},
           CASE WHEN m.score IS NULL OR v.relevance_score > m.score + 0.1 THEN v.relevance_score ELSE m.score + 0.1 END AS relevance_score,
           CASE WHEN m.score IS NULL OR v.relevance_score > m.score + 0.1 THEN 'vector' ELSE 'metadata' END AS origin,
           coalesce(m.rank, 1099511627776 + v.rank) AS ord
    FROM meta_hits m FULL JOIN (
        SELECT query_id, {KEYS}, max(relevance_score) AS relevance_score, min(rank) AS rank FROM request_ranked GROUP BY ALL) v
    USING (query_id, {KEYS})
"""
HYBRID_REASON = "'Hybrid match: semantic similarity + metadata keywords'"


def hybrid_merge_hits(spark, sf):
    asked = requests(spark, sf).select(F.col("request_id").alias("query_id"), "repo_id", focus_level("focus").alias("level"), "embedding")
    vec = rerank(to_results(vector_search(levels(spark, sf), asked, 20)), rankings(spark, sf))
    merged = hybrid_merge(metadata_search(text_levels(spark, sf), request_terms(spark, sf), 10), vec)
    return merged.select("query_id", "repo_id", "type", "file_path", "name", "position",
                         F.round("relevance_score", 6).alias("relevance_score"), "origin", "match_reason")


HYBRID_MERGE_HITS = sql(f"""
    SELECT query_id, repo_id, type, file_path, name, position, round(relevance_score, 6) AS relevance_score, origin,
           {HYBRID_REASON} AS match_reason
    FROM merged
""")


def best_hit_per_file(spark, sf):
    """Best function name hit of every file over all name hits of a lookup."""
    hits = keyword_filter(text_levels(spark, sf), KEYWORDS, "all")
    scored = keyword_rank(hits, KEYWORDS, None).withColumn("query_id", F.lit(0).cast("bigint"))
    best = best_per_file(scored, None, [F.desc("relevance_score"), "type", "name", "position"])
    return best.select("repo_id", "file_path", "type", "name", F.round("relevance_score", 6).alias("relevance_score"))


BEST_HIT_PER_FILE = sql(f"""
    SELECT repo_id, file_path, type, name, round(s, 6) AS relevance_score FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY s DESC, type, name, position) AS rn FROM (
            SELECT *, {relevance_sql('content', KEYWORDS)} AS s FROM artifacts WHERE {ilikes('content', KEYWORDS)}))
    WHERE rn = 1
""")


def hybrid_search_requests(spark, sf):
    found = hybrid_search(levels(spark, sf), requests(spark, sf), rankings(spark, sf), 20, text_levels(spark, sf))
    return found.withColumn("relevance_score", F.round("relevance_score", 6))


CTES["hybrid_hits"] = f"""
    SELECT h.query_id, h.rank, h.repo_id, h.type, h.file_path, h.parent_class, h.name, h.position, h.relevance_score,
           a.content AS enhanced_content, {HYBRID_REASON} AS match_reason, a.rich_metadata
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, ord) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, repo_id, file_path ORDER BY relevance_score DESC, ord) AS in_file FROM merged)
          WHERE in_file = 1) h
    JOIN artifacts a ON a.type = h.type AND a.file_path = h.file_path AND a.name = h.name AND a.position = h.position
    WHERE rank <= 20
"""
HYBRID_SEARCH_REQUESTS = sql("SELECT * REPLACE (round(relevance_score, 6) AS relevance_score) FROM hybrid_hits")


def keyword_match_requests(spark, sf):
    asked = requests(spark, sf).withColumnRenamed("request_id", "query_id")
    return keyword_match(text_levels(spark, sf), asked, 20).withColumn("relevance_score", F.round("relevance_score", 6))


N_WORDS = f"len({word_list('lower(content)').replace('{{', '{').replace('}}', '}')})"
CTES["keyed_hits"] = f"""
    SELECT query_id, tool, rank, {KEYS}, content, rich_metadata, round(s, 6) AS relevance_score, match_reason FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, file_path, level, name, parent_class, repo_id, position) AS rank
        FROM (SELECT *, CASE WHEN n > 0 THEN least(list_sum(list_transform(keywords, lambda k:
                        (length(lower(content)) - length(replace(lower(content), k, ''))) // length(k))) / (n * len(keywords) * 0.01::DOUBLE), 1.0::DOUBLE)
                     ELSE 0.0::DOUBLE END AS s
              FROM (SELECT r.request_id AS query_id, r.tool, r.keywords, 'Keyword matches: ' || array_to_string(keywords, ', ') AS match_reason,
                           a.*, {N_WORDS} AS n
                    FROM requests r JOIN artifacts a ON {SAME_REPO} AND r.scope_level IN ('all', a.type)
                    WHERE len(list_filter(keywords, lambda k: contains(lower(content), k))) > 0)))
    WHERE rank <= 20
"""
KEYWORD_MATCH_REQUESTS = sql(f"""
    SELECT query_id, rank, {KEYS}, content AS enhanced_content, rich_metadata, relevance_score, match_reason FROM keyed_hits
""")


def text_index(spark, sf) -> KeywordIndex:
    """The index of all artifacts: files first, the other levels added to it."""
    index = KeywordIndex(shared_dir(spark, "keyword-index"))
    found = text_levels(spark, sf)
    add_to_index({"file": found.pop("file")}, index)
    add_to_index(found, index)
    return index


def indexed_keyword_match(spark, sf):
    """As keyword_match, and with the same SQL: every benchmark item asks for its first two terms."""
    asked = requests(spark, sf).withColumnRenamed("request_id", "query_id")
    return indexed_match(spark, text_index(spark, sf), asked, 20).withColumn("relevance_score", F.round("relevance_score", 6))


def indexed_keyword_filter(spark, sf):
    hits = indexed_filter(spark, text_index(spark, sf), KEYWORDS, "all")
    return hits.select("repo_id", "type", "file_path", "name", "position", "rich_metadata")


def routed_search_requests(spark, sf):
    found = routed_search(levels(spark, sf), requests(spark, sf), rankings(spark, sf), 20, text_levels(spark, sf))
    return found.withColumn("relevance_score", F.round("relevance_score", 6))


ROUTED_SEARCH_REQUESTS = sql(f"""
    SELECT query_id, 'hybrid_search' AS tool, rank, {KEYS}, round(relevance_score, 6) AS relevance_score, enhanced_content, match_reason, rich_metadata
    FROM hybrid_hits WHERE query_id IN (SELECT request_id FROM requests WHERE tool IN ('hybrid_search', 'unknown_tool'))
    UNION ALL
    SELECT query_id, tool, rank, {KEYS}, relevance_score, content, match_reason, rich_metadata FROM keyed_hits WHERE tool = 'keyword_match'
    UNION ALL
    SELECT query_id, tool, NULL::BIGINT, {KEYS}, 1.0::DOUBLE, content, match_reason, rich_metadata FROM named_hits WHERE tool = 'identify_file'
""")

QUERIES = {
    "artifact_scan": (artifact_scan, ARTIFACT_SCAN),
    "vector_topk": (vector_topk_file, VECTOR_TOPK_FILE),
    "vector_search": (vector_search_all, VECTOR_SEARCH_ALL),
    "similarity_results": (similarity_results, SIMILARITY_RESULTS),
    "name_lookup": (name_lookup_requests, NAME_LOOKUP_REQUESTS),
    "metadata_search": (metadata_search_terms, METADATA_SEARCH_TERMS),
    "query_terms": (query_terms, QUERY_TERMS),
    "keyword_filter": (keyword_filter_all, KEYWORD_FILTER_ALL),
    "keyword_filter_files": (keyword_filter_files, KEYWORD_FILTER_FILES),
    "keyword_relevance": (keyword_relevance_all, KEYWORD_RELEVANCE_ALL),
    "keyword_top": (keyword_top, KEYWORD_TOP),
    "keyword_match": (keyword_match_requests, KEYWORD_MATCH_REQUESTS),
    "indexed_keyword_match": (indexed_keyword_match, KEYWORD_MATCH_REQUESTS),
    "indexed_keyword_filter": (indexed_keyword_filter, KEYWORD_FILTER_ALL),
    "rerank": (rerank_labels, RERANK_LABELS),
    "candidate_cards": (candidate_descriptions, CANDIDATE_DESCRIPTIONS),
    "hybrid_merge": (hybrid_merge_hits, HYBRID_MERGE_HITS),
    "best_per_file": (best_hit_per_file, BEST_HIT_PER_FILE),
    "hybrid_search": (hybrid_search_requests, HYBRID_SEARCH_REQUESTS),
    "routed_search": (routed_search_requests, ROUTED_SEARCH_REQUESTS),
}
