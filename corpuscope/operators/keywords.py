"""Name, metadata and keyword search for tables of requests: all terms of all requests meet the artifacts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import any_of, count_occurrences, ilike_term, word_count, words
from corpuscope.operators.matching import match_terms
from corpuscope.operators.topk import first_per_group
from corpuscope.sources.artifacts import KEYS, LEVELS, SCOPE_LEVEL, all_levels, level_rank, scope_level

# Words that are no search terms, shortest term, score per level.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
MIN_TERM_LENGTH = 3
METADATA_SCORE = {"function": 0.95, "class": 0.9, "file": 0.85}
METADATA_ORDER = ["function", "class", "file"]
DENSITY = 0.01


def extract_terms(df: DataFrame, text: str, keys) -> DataFrame:
    """Search terms of a text: lower case, punctuation removed, longer than two characters, no stop words."""
    cleaned = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    kept = F.filter(cleaned, lambda w: (F.length(w) >= MIN_TERM_LENGTH) & ~w.isin(STOP_WORDS))
    return df.select(*keys, F.posexplode(kept).alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


# Kinds of terms: looked for in names, or in both texts.
NAME, TEXT = "name", "text"


def find_terms(levels: dict[str, DataFrame], terms: DataFrame, literal: bool = False, kinds=(NAME, TEXT)) -> DataFrame:
    """Where the terms of all requests stand: ``*KEYS, kind, term, n, words``; the artifacts are read once for all of them.

    ``terms``: kind, term (lower case). Give the result to several searches as ``hits`` and they share that one read.
    """
    source = all_levels(levels)
    columns = {"__name": F.lower("name")} if NAME in kinds else {}
    if TEXT in kinds:
        # The second text only where it differs from the first.
        original = F.when(~F.col("original_content").eqNullSafe(F.col("enhanced_content")), F.lower("original_content"))
        columns |= {"__enhanced": F.lower("enhanced_content"), "__original": original}
    texts = {NAME: ["__name"], TEXT: ["__enhanced", "__original"]}
    return match_terms(source.withColumns(columns), KEYS, {k: texts[k] for k in kinds}, terms, literal)


def _asked(requests: DataFrame, kind: str) -> DataFrame:
    """Requests, one row per term, as terms to look for."""
    return requests.select(F.lit(kind).alias("kind"), "term")


def _meet(hits: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """Hits with the requests that asked for their term in their repository; requests are the alias ``r``, hits ``h``."""
    repo = F.col("r.repo_id").isNull() | (F.col("r.repo_id") == F.col("h.repo_id"))
    return hits.where(F.col("kind") == kind).alias("h").join(requests.alias("r"), (F.col("h.term") == F.col("r.term")) & repo)


def _with_repo(requests: DataFrame) -> DataFrame:
    """Requests with a ``repo_id``; NULL stands for all repositories."""
    return requests if "repo_id" in requests.columns else requests.withColumn("repo_id", F.lit(None).cast("string"))


def lookup_terms(requests: DataFrame) -> DataFrame:
    """Requests for names, one row per name: query_id, repo_id, level, names, term."""
    return _with_repo(requests).select("query_id", "repo_id", "level", "names", F.explode(F.split("names", ",")).alias("__one")).select(
        "query_id", "repo_id", "level", "names", F.lower(F.trim("__one")).alias("term")).distinct()


def name_hits(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Keys of the artifacts that :func:`name_lookup` finds, with relevance_score and match_reason."""
    found = _meet(hits, lookup_terms(requests).where(F.col("level").isin(LEVELS)), NAME).where(F.col("r.level") == F.col("h.type"))
    return found.groupBy("r.query_id", *[F.col(f"h.{k}").alias(k) for k in KEYS]).agg(
        F.any_value("r.level").alias("level"), F.any_value("r.names").alias("names")).select(
        "query_id", *KEYS, F.lit(1.0).alias("relevance_score"),
        F.concat(F.lit("Exact "), F.col("level"), F.lit(" match: "), F.col("names")).alias("match_reason"))


def name_lookup(levels: dict[str, DataFrame], requests: DataFrame, literal: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """Rows whose name contains one of the names.

    ``requests``: query_id, level, names (comma-separated), and repo_id where wanted, one row per query. A level that does
    not exist finds nothing.
    """
    hits = hits if hits is not None else find_terms(levels, _asked(lookup_terms(requests), NAME), literal, (NAME,))
    texts = all_levels(levels).select(*KEYS, *[F.coalesce(c, F.lit("")).alias(c) for c in ("enhanced_content", "rich_metadata")])
    return name_hits(requests, hits).join(texts, KEYS).select(
        "query_id", *KEYS, "relevance_score", "enhanced_content", "match_reason", "rich_metadata")


def metadata_terms(terms: DataFrame) -> DataFrame:
    """Terms of requests in lower case: query_id, repo_id, pos, term."""
    return _with_repo(terms).select("query_id", "repo_id", "pos", F.lower("term").alias("term"))


def metadata_search(levels: dict[str, DataFrame], terms: DataFrame, k: int = 20, literal: bool = False,
                    hits: DataFrame | None = None) -> DataFrame:
    """Name matches of single terms with a fixed score per level.

    ``terms``: query_id, pos, term (as :func:`extract_terms` gives them), and repo_id where wanted. Per term and level
    the first ``k`` by name are taken; a row found by several terms counts for the first one; the best ``k`` per query
    remain. ``rank`` is the position in that list.
    """
    asked = metadata_terms(terms)
    hits = hits if hits is not None else find_terms(levels, _asked(asked, NAME), literal, (NAME,))
    branch = F.array_position(F.array(*[F.lit(x) for x in METADATA_ORDER]), F.col("type")).cast("int")
    score = F.create_map(*[F.lit(v) for pair in METADATA_SCORE.items() for v in pair])[F.col("type")]
    named = _meet(hits, asked, NAME).select(
        "r.query_id", F.col("r.pos").alias("term_pos"), *[F.col(f"h.{k}").alias(k) for k in KEYS])
    named = named.withColumns({"branch": branch, "score": score})
    by_name = ["name", "file_path", "parent_class", "repo_id", "position"]
    named = first_per_group(named, ["query_id", "term_pos", "type"], by_name, k)
    named = first_per_group(named, ["query_id", *KEYS], ["term_pos"], 1)
    order = [F.desc("score"), "term_pos", "branch", *by_name]
    return first_per_group(named, ["query_id"], order, k, rank="rank").select("query_id", "rank", *KEYS, "score")


def _lowered(artifacts: DataFrame) -> DataFrame:
    """Both texts in lower case, and the second one only where it differs from the first."""
    original = F.when(~F.col("original_content").eqNullSafe(F.col("enhanced_content")), F.lower("original_content"))
    return artifacts.withColumns({"__enhanced": F.lower("enhanced_content"), "__original": original})


def keyword_condition(keywords, literal: bool = False) -> Column:
    """Any keyword in the enhanced or the original text, both in lower case."""
    return any_of(
        F.coalesce(ilike_term(c, k, literal), F.lit(False)) for k in keywords for c in ("__enhanced", "__original")
    )


def keyword_relevance(lowered, n_words, keywords) -> Column:
    """Keyword hits per word and keyword relative to a density of one percent, at most 1; 0 without words."""
    hits = sum((count_occurrences(lowered, k.lower()) for k in keywords if k), F.lit(0))
    count = F.col(n_words) if isinstance(n_words, str) else n_words
    score = F.least(hits / (count * F.lit(max(len(keywords), 1)) * F.lit(DENSITY)), F.lit(1.0))
    return F.when(count > 0, score).otherwise(F.lit(0.0))


def keyword_filter(levels: dict[str, DataFrame], keywords, scope: str = "all", literal: bool = False) -> DataFrame:
    """Artifacts with any of the keywords in either text, over one level or all."""
    source = all_levels(levels, SCOPE_LEVEL.get(scope, "file"))
    return _lowered(source).where(keyword_condition(keywords, literal)).select(*source.columns)


def _word_counts(hits: DataFrame) -> DataFrame:
    """Lower-case text and its number of words as columns of their own, so each is computed once per row."""
    texts = hits.withColumn("__enhanced", F.lower(F.coalesce("enhanced_content", F.lit(""))))
    return texts.withColumn("__words", word_count("__enhanced"))


def _ranking() -> list:
    """Order of keyword hits: score, then where they stand."""
    return [F.desc("relevance_score"), "file_path", level_rank(), "name", "parent_class", "repo_id", "position"]


def keyword_rank(hits: DataFrame, keywords, k: int | None = 20) -> DataFrame:
    """Keyword hits with their score; the best ``k``, or all with ``k=None``. Ties go by path, level and name."""
    scored = _word_counts(hits).select(
        *KEYS,
        "enhanced_content",
        "rich_metadata",
        keyword_relevance("__enhanced", "__words", keywords).alias("relevance_score"),
        F.lit("Keyword matches: " + ", ".join(keywords)).alias("match_reason"),
    )
    if k is None:
        return scored
    return scored.orderBy(*_ranking()).limit(k)


def keyword_terms(requests: DataFrame) -> DataFrame:
    """Keyword requests, one row per keyword, repeated ones as often: query_id, repo_id, level, asked, joined, term."""
    words_of = F.coalesce("keywords", F.array().cast("array<string>"))
    return _with_repo(requests).select(
        "query_id", "repo_id", scope_level("scope").alias("level"), F.size(words_of).alias("asked"),
        F.concat_ws(", ", words_of).alias("joined"), F.explode(F.transform(words_of, F.lower)).alias("term"))


def keyword_hits(requests: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """Keys of the best ``k`` artifacts of each keyword request, with rank, relevance_score and match_reason."""
    found = _meet(hits, keyword_terms(requests), TEXT).where((F.col("r.level") == "all") | (F.col("r.level") == F.col("h.type")))
    sums = found.groupBy("r.query_id", *[F.col(f"h.{k}").alias(k) for k in KEYS]).agg(
        F.sum("n").alias("n"), F.any_value("words").alias("words"), F.any_value("asked").alias("asked"), F.any_value("joined").alias("joined"))
    score = F.least(F.col("n") / (F.col("words") * F.greatest("asked", F.lit(1)) * F.lit(DENSITY)), F.lit(1.0))
    ranked = sums.select(
        "query_id", *KEYS, F.when(F.col("words") > 0, score).otherwise(F.lit(0.0)).alias("relevance_score"),
        F.concat(F.lit("Keyword matches: "), "joined").alias("match_reason"))
    return first_per_group(ranked, ["query_id"], _ranking(), k, rank="rank")


def keyword_match(levels: dict[str, DataFrame], requests: DataFrame, k: int = 20, literal: bool = False,
                  hits: DataFrame | None = None) -> DataFrame:
    """Filter and rank for a table of requests: query_id, keywords (array), scope, and repo_id where wanted, one row per query.

    The texts are read once for the keywords of all requests, and once more for the winners' results.
    """
    hits = hits if hits is not None else find_terms(levels, _asked(keyword_terms(requests), TEXT), literal, (TEXT,))
    texts = all_levels(levels).select(*KEYS, "enhanced_content", "rich_metadata")
    return keyword_hits(requests, hits, k).join(texts, KEYS).select(
        "query_id", *KEYS, "enhanced_content", "rich_metadata", "relevance_score", "match_reason", "rank")
