"""Exact duplicates, with the frequent texts split off: Misra-Gries counters, verified winners, ordinary shuffle for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.session import staged

# Counters of a summary; a digest in more than 1 / (HEAVY + 1) of the rows is always found.
HEAVY = 1024


def _summary(size: int):
    """Misra-Gries over the batches of one partition: at most ``size`` digests with a lower bound of their count.

    A batch is counted as a whole and added; then the (size + 1)-th largest counter is taken off all, which is what
    the single steps of the algorithm amount to (mergeable summaries).
    """

    def run(batches):
        kept = pa.table({"digest": pa.array([], pa.binary()), "low": pa.array([], pa.int64())})
        for batch in batches:
            counted = pa.table({"digest": batch.column("digest")}).group_by("digest").aggregate([([], "count_all")])
            counted = counted.select(["digest", "count_all"]).rename_columns(["digest", "low"])
            both = pa.concat_tables([kept, counted]).group_by("digest").aggregate([("low", "sum")])
            low = both["low_sum"].to_numpy()
            if len(low) > size:
                low = low - np.partition(low, len(low) - size - 1)[len(low) - size - 1]
            kept = pa.table({"digest": both["digest"], "low": low}).filter(pa.array(low > 0)).combine_chunks()
        yield from kept.to_batches()

    return run


def heavy_digests(digests: DataFrame, size: int = HEAVY) -> DataFrame:
    """Candidates for frequent digests, at most ``size``: the merged summaries of all partitions (digest)."""
    parts = digests.select("digest").mapInArrow(_summary(size), "digest binary, low bigint")
    merged = parts.groupBy("digest").agg(F.sum("low").alias("low"))
    return merged.orderBy(F.desc("low"), "digest").limit(size).select("digest")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Group of equal texts of every row.

    Returns ``<id_col>, digest (binary), keep_id, group_size, kept`` with one row per row of ``docs``. Texts are equal
    when their UTF-8 bytes are (SHA-256); null counts as the empty text. The largest id of a group stays; rows that
    repeat both id and text are counted and carry the same flags. Null ids lose against any id; in a group of null ids
    only, those rows are kept. An empty table gives an empty result. Other columns of ``docs`` are not looked at.

    Only (id, digest) leave the scan. Digests in more than 1/(heavy+1) of the rows are found by Misra-Gries, counted
    exactly, and marked where they are against at most ``heavy`` broadcast rows; only the rest is grouped by shuffling,
    so no key of the shuffle holds more than that share.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    digests = staged(docs.select(col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    candidates = F.broadcast(heavy_digests(digests, heavy))
    facts = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = staged(digests.join(candidates, "digest").groupBy("digest").agg(*facts), "winners")
    # At most `heavy` rows, by the limit above.
    marked = digests.join(F.broadcast(winners), "digest", "left")
    frequent = marked.where(F.col("group_size").isNotNull())
    w = Window.partitionBy("digest")
    rest = marked.where(F.col("group_size").isNull()).select(
        "id", "digest", F.max("id").over(w).alias("keep_id"), F.count(F.lit(1)).over(w).alias("group_size"))
    return frequent.select("id", "digest", "keep_id", "group_size").unionByName(rest).select(
        F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``docs`` with one row for each different text, all columns as they were.

    The row with the largest id stays (see :func:`duplicate_groups`); of rows that repeat id and text one stays.
    """
    digest, kept_id, kept_digest = (fresh(docs, c) for c in ("digest", "kept_id", "kept_digest"))
    groups = duplicate_groups(docs, id_col, text_col, heavy).where("kept")
    kept = staged(groups.groupBy(F.col(id_col).alias(kept_id), F.col("digest").alias(kept_digest)).agg(
        (F.count(F.lit(1)) > 1).alias("again")), "kept")
    own = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")), 256)))

    def matching(keys):
        return own.join(keys.drop("again"), col(id_col).eqNullSafe(col(kept_id)) & (col(digest) == col(kept_digest)))

    found, repeated = matching(kept.where("not again")), kept.where("again")
    if not repeated.isEmpty():
        found = found.unionByName(matching(repeated).dropDuplicates([id_col, digest]))
    return found.select(*[col(c) for c in docs.columns])
