"""Hybrid and routed search for tables of requests: compositions of the retrieval operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.keywords import (
    NAME,
    TEXT,
    extract_terms,
    find_terms,
    keyword_hits,
    keyword_terms,
    lookup_terms,
    metadata_search,
    metadata_terms,
    name_hits,
)
from corpuscope.operators.merge import best_per_file, hybrid_merge, rerank
from corpuscope.operators.vectors import vector_search, with_content
from corpuscope.session import staged
from corpuscope.sources.artifacts import KEYS, all_levels, focus_level

# One row per search call. ``tool`` is identify_file, keyword_match or hybrid_search; any other means hybrid. Without a
# ``repo_id`` all repositories are searched; the other columns are those the tool reads.
REQUEST_SCHEMA = ("request_id bigint, repo_id string, tool string, text string, embedding array<double>, focus string, level string, "
                  "names string, keywords array<string>, scope string")

RESULT = ["query_id", "rank", *KEYS, "relevance_score", "enhanced_content", "match_reason", "rich_metadata"]


def _complete(hits: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """Results with the texts of their artifacts."""
    texts = [c for c in ("enhanced_content", "rich_metadata") if c not in hits.columns]
    full = with_content(hits, all_levels(levels), texts) if texts else hits
    return full.withColumns({c: F.coalesce(c, F.lit("")) for c in ("enhanced_content", "rich_metadata")})


def _hybrid(levels: dict[str, DataFrame], asked: DataFrame, terms: DataFrame, hits: DataFrame | None, rankings: DataFrame,
            max_results: int, texts: dict[str, DataFrame]) -> DataFrame:
    """Hits of hybrid search without their texts."""
    near = vector_search(levels, asked.select("query_id", "repo_id", focus_level("focus").alias("level"), "embedding"), max_results)
    candidates = near.select(
        "query_id", "rank", *KEYS, (F.lit(1.0) - F.col("distance")).alias("relevance_score"), F.lit("").alias("match_reason"))
    merged = hybrid_merge(metadata_search(texts, terms, max_results // 2, hits=hits), rerank(candidates, rankings))
    return best_per_file(merged, max_results)


def hybrid_search(levels: dict[str, DataFrame], requests: DataFrame, rankings: DataFrame, max_results: int = 20,
                  text_levels: dict[str, DataFrame] | None = None) -> DataFrame:
    """Vector search reranked by given scores, merged with name matches, best hit per file, with the texts of the hits.

    ``requests``: request_id, repo_id, text, embedding, focus. The artifacts are read once for the vectors, once for the
    names and once for the texts of the winners, whatever the number of requests. ``text_levels`` are the levels to
    read names and texts from, where those with embeddings cost more.
    """
    texts = text_levels or levels
    asked = requests.withColumnRenamed("request_id", "query_id")
    terms = extract_terms(asked, "text", ["query_id", "repo_id"])
    return _complete(_hybrid(levels, asked, terms, None, rankings, max_results, texts), texts).select(*RESULT)


def routed_search(levels: dict[str, DataFrame], requests: DataFrame, rankings: DataFrame, max_results: int = 10,
                  text_levels: dict[str, DataFrame] | None = None) -> DataFrame:
    """Each request (``REQUEST_SCHEMA``) with the tool it names.

    The terms of all requests, whatever their tool, meet names and texts in one read; that table of hits is written and
    every tool takes its own from it. The vectors are read once, and the texts of all winners once.
    """
    texts = text_levels or levels
    tool = F.when(F.col("tool").isin("identify_file", "keyword_match"), F.col("tool")).otherwise(F.lit("hybrid_search"))
    asked = staged(requests.withColumn("tool", tool).withColumnRenamed("request_id", "query_id"), "requests")
    named, keyed, mixed = (asked.where(F.col("tool") == t) for t in ("identify_file", "keyword_match", "hybrid_search"))
    terms = extract_terms(mixed, "text", ["query_id", "repo_id"])
    wanted = [(NAME, lookup_terms(named)), (NAME, metadata_terms(terms)), (TEXT, keyword_terms(keyed))]
    hits = staged(find_terms(texts, reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("kind"), "term") for kind, t in wanted])), "hits")
    parts = {
        "identify_file": name_hits(named, hits).withColumn("rank", F.lit(None).cast("bigint")),
        "keyword_match": keyword_hits(keyed, hits, max_results),
        "hybrid_search": _hybrid(levels, mixed, terms, hits, rankings, max_results, texts)}
    columns = ["query_id", "rank", *KEYS, "relevance_score", "match_reason"]
    winners = reduce(DataFrame.unionByName, [found.select(*columns, F.lit(name).alias("tool")) for name, found in parts.items()])
    return _complete(winners, texts).select("query_id", "tool", *RESULT[1:])
