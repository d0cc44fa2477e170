"""Artifact index: file, class and function rows with text and embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The levels in tie order.
LEVELS = ["file", "class", "function"]
NAME_COLUMN = {"file": "file_path", "class": "class_name", "function": "function_name"}

ARTIFACT_COLUMNS = {
    "repo_id": "string",
    "type": "string",
    "file_path": "string",
    "name": "string",
    "parent_class": "string",
    "position": "bigint",
    "programming_language": "string",
    "enhanced_content": "string",
    "original_content": "string",
    "rich_metadata": "string",
    "embedding": "array<float>",
}

# What tells artifacts apart; ``position`` (such as the first line) only where all else repeats.
KEYS = ["repo_id", "type", "file_path", "parent_class", "name", "position"]
_ABSENT = {"repo_id": "", "parent_class": "", "position": 0}


def level_rank(level="type") -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c)


def as_artifacts(df: DataFrame, level: str) -> DataFrame:
    """Bring one level table to the common artifact columns; missing ones become NULL, in the key '' or 0."""
    have = set(df.columns)

    def column(name, dtype):
        if name == "type":
            return F.lit(level).alias("type")
        source = NAME_COLUMN[level] if name == "name" else name
        found = F.col(source).cast(dtype) if source in have else F.lit(None).cast(dtype)
        return (F.coalesce(found, F.lit(_ABSENT[name]).cast(dtype)) if name in _ABSENT else found).alias(name)

    return df.select([column(n, t) for n, t in ARTIFACT_COLUMNS.items()])


def read_artifacts(spark: SparkSession, root: str, level: str, repo_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Artifacts of one level below ``root/level``.

    Written by :func:`write_artifacts` the index is partitioned by ``repo_id``, so the filter prunes folders.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {LEVELS}")
    df = spark.read.format(fmt).load(f"{root}/{level}")
    return as_artifacts(df if repo_id is None else df.where(F.col("repo_id") == repo_id), level)


def read_artifacts_jdbc(spark: SparkSession, table: str, level: str, options: dict, repo_id: str | None = None) -> DataFrame:
    """Artifacts of one level from a database table.

    ``options`` carries url, driver, credentials and the partitioned-read settings
    (partitionColumn, lowerBound, upperBound, numPartitions); the repository filter is pushed to the database.
    """
    df = spark.read.format("jdbc").options(dbtable=table, **options).load()
    if repo_id is not None:
        df = df.where(F.col("repo_id") == repo_id)
    return as_artifacts(df, level)


def write_artifacts(df: DataFrame, root: str, level: str, mode: str = "append", files_per_repo: int = 16) -> None:
    """Store one level partitioned by repository.

    Rows of a repository are spread by path over ``files_per_repo`` tasks, so one that holds most of the
    rows is not written by a single task; raise the number with its size.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {LEVELS}")
    stored = df.drop("name", "type") if level == "file" else df.withColumnRenamed("name", NAME_COLUMN[level]).drop("type")
    part = F.pmod(F.xxhash64("file_path"), F.lit(files_per_repo))
    (
        stored.repartition("repo_id", part)
        .sortWithinPartitions("repo_id", "file_path")
        .write.mode(mode)
        .partitionBy("repo_id")
        .parquet(f"{root}/{level}")
    )


def all_levels(levels: dict[str, DataFrame], level: str = "all") -> DataFrame:
    """One level, or the three stacked in level order."""
    wanted = [level] if level in LEVELS else LEVELS
    return reduce(DataFrame.unionByName, [levels[x] for x in wanted if x in levels])


# Focus words of a request and the level each one means.
FOCUS_LEVEL = {"files": "file", "classes": "class", "functions": "function", "all": "all"}


def focus_level(focus) -> Column:
    """Level a focus word means; any other word means all."""
    return _meaning(focus, FOCUS_LEVEL, "all")


# Scope words of a keyword request; any other word means files.
SCOPE_LEVEL = {"files": "file", "classes": "class", "functions": "function", "all": "all"}


def scope_level(scope) -> Column:
    """Level a scope word means."""
    return _meaning(scope, SCOPE_LEVEL, "file")


def _meaning(word, meanings: dict, default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.col(word) if isinstance(word, str) else word, F.lit(""))), F.lit(default))
