"""Reranking by given scores, hybrid merge and best hit per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.topk import first_per_group
from corpuscope.sources.artifacts import KEYS

# Sizes and texts of the hybrid merge.
RERANK_KEEP = 8
SUMMARY_CHARS = 150
METADATA_BOOST = 0.1
HYBRID_REASON = "Hybrid match: semantic similarity + metadata keywords"


def candidate_cards(candidates: DataFrame) -> DataFrame:
    """Candidates as shown to a ranker: 0-based index, score to three decimals, shortened description."""
    text = F.coalesce("enhanced_content", F.lit(""))
    short = F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit("..."))
    return candidates.select(
        "query_id",
        (F.col("rank") - 1).cast("bigint").alias("index"),
        *KEYS,
        F.round("relevance_score", 3).alias("base_score"),
        F.when(F.length(text) > SUMMARY_CHARS, short).otherwise(text).alias("description"),
    )


def rerank(candidates: DataFrame, rankings: DataFrame, keep: int = RERANK_KEEP, min_relevance: float | None = None) -> DataFrame:
    """Candidates in the order of an external ranking, the first ``keep`` per query.

    ``rankings``: query_id, pos, index, relevance, reason. Indexes outside the candidate list fall away; queries
    without any ranking keep their first candidates. The candidates are read once, so the search below runs once;
    they and the rankings are lists of a few rows per query.
    """
    ranks = rankings if min_relevance is None else rankings.where(F.col("relevance") >= min_relevance)
    ranks = ranks.select("query_id", "index", "pos", "relevance", "reason")
    ranked_queries = ranks.select("query_id").distinct().withColumn("__ranked", F.lit(True))
    rows = (
        candidates.withColumn("index", F.col("rank") - 1)
        .join(ranks, ["query_id", "index"], "left")
        .join(ranked_queries, "query_id", "left")
        .where(F.when(F.col("__ranked"), F.col("relevance").isNotNull()).otherwise(F.col("rank") <= keep))
    )
    extra = [c for c in ("enhanced_content", "rich_metadata") if c in candidates.columns]
    scored = rows.select(
        "query_id",
        F.coalesce("pos", "index").alias("pos"),
        *KEYS,
        F.coalesce(F.col("relevance") / F.lit(10.0), "relevance_score").alias("relevance_score"),
        F.coalesce("reason", "match_reason").alias("match_reason"),
        *extra,
    )
    return first_per_group(scored, ["query_id"], ["pos", *KEYS], keep, rank="rank").drop("pos")


def hybrid_merge(meta: DataFrame, vec: DataFrame) -> DataFrame:
    """Metadata and vector hits by key; a vector hit wins only with a strictly higher score.

    Metadata scores are raised by 0.1. ``ord`` is the tie order: metadata list first, then vector list.
    Both sides are result lists of a few rows per query.
    """
    m = meta.select(
        "query_id", *KEYS,
        (F.col("score") + METADATA_BOOST).alias("m_score"),
        F.col("rank").alias("m_rank"),
    )
    # A ranking may name one candidate twice; the better place and score stand for it.
    v = vec.groupBy("query_id", *KEYS).agg(
        F.max("relevance_score").alias("v_score"), F.min("rank").alias("v_rank")
    )
    merged = m.join(v, ["query_id", *KEYS], "full_outer")
    replaced = F.col("m_score").isNull() | (F.col("v_score") > F.col("m_score"))
    return merged.select(
        "query_id",
        *KEYS,
        F.when(replaced, F.col("v_score")).otherwise(F.col("m_score")).alias("relevance_score"),
        F.when(replaced, F.lit("vector")).otherwise(F.lit("metadata")).alias("origin"),
        F.lit(HYBRID_REASON).alias("match_reason"),
        F.coalesce(F.col("m_rank"), F.lit(1 << 40) + F.col("v_rank")).alias("ord"),
    )


def best_per_file(df: DataFrame, k: int | None, order=None) -> DataFrame:
    """First row of each file of a repository in score order, then the first ``k`` files per query."""
    order = order or [F.desc("relevance_score"), "ord"]
    best = first_per_group(df, ["query_id", "repo_id", "file_path"], order, 1)
    if k is None:
        return best
    return first_per_group(best, ["query_id"], order, k, rank="rank")
