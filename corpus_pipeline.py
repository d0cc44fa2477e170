"""Training-data pipeline over ``documents``: quality, exact copies, near copies, benchmark passages, mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import decontaminate, exact, mixing, ngram_join, quality
from corpuscope.llm.queries import quality_model
from corpuscope.llm.tables import table
from corpuscope.session import staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality_model(docs, spark, sf_dir))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.keep_one(docs, by_text=True)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; adds ``copy``, the number of a repeated document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equal),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources to target weights", mixed),
]

# The classifier cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
