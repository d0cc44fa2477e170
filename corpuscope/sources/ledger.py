"""Ledger of runs that passed validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of the entry and its time texts.
STAMP = "yyyyMMdd_HHmmss"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PASSED = "PASSED"


def iso_text(c) -> F.col:
    """ISO text of a timestamp; like ``isoformat`` the fraction is left out when it is zero."""
    full = F.date_format(c, ISO)
    return F.when(F.endswith(full, F.lit(".000000")), F.substring_index(full, ".", 1)).otherwise(full)


def ledger_entries(runs: DataFrame, saved_at="saved_at", user="user_id", passed="code_validator_success") -> DataFrame:
    """One entry per passed run; the other columns are kept as the JSON ``bot_state``."""
    state = [c for c in runs.columns if c not in (saved_at, user)]
    types = dict(runs.dtypes)
    as_text = [iso_text(c).alias(c) if types[c].startswith("timestamp") else F.col(c) for c in state]
    return runs.where(F.col(passed)).select(
        F.coalesce(F.col(user).cast("string"), F.lit("default_user")).alias("user_id"),
        F.date_format(saved_at, STAMP).alias("timestamp"),
        iso_text(saved_at).alias("saved_at"),
        F.lit(PASSED).alias("validation_status"),
        F.to_json(F.struct(*as_text)).alias("bot_state"),
    )


def append_ledger(runs: DataFrame, path: str, **columns) -> None:
    """Append entries as JSON records in one folder per user."""
    ledger_entries(runs, **columns).write.partitionBy("user_id").mode("append").json(path)


LEDGER_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["timestamp", "saved_at", "validation_status", "bot_state", "user_id"]]
)


def read_ledger(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """Ledger entries; a user filter prunes to that user's folder."""
    df = spark.read.schema(LEDGER_SCHEMA).json(path)
    return df if user is None else df.where(F.col("user_id") == user)
