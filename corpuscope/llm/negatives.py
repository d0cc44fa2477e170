"""Hard negatives by slots: the upper limits of an anchor's positives split its scores into disjoint slots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import col
from corpuscope.session import shared_dir, staged

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
# Anchors that meet all rows in one pass, bytes of their vectors at most, and the sides of one product of blocks.
ANCHORS = 1 << 15
ANCHOR_BYTES = 1 << 25
BLOCK = 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of equal width, shorter ones filled with 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths),
        np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; sums beyond 64 bits stay at the ends of that range."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = max(1, width) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if largest < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


class Best:
    """The ``k`` best rows of every slot of some anchors: higher scores first, then smaller ids, null ids last."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.slots, self.k = slots, k
        self.key = self.score = self.id = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)
        self.least = np.full(anchors * slots, LEAST)

    def add(self, anchor, slot, score, row_id, unnamed):
        key = anchor * self.slots + slot
        hit = score >= self.least[key]
        if not hit.any():
            return
        key, score, row_id, unnamed = (np.concatenate([old, new[hit]]) for old, new in (
            (self.key, key), (self.score, score), (self.id, row_id), (self.unnamed, unnamed)))
        order = np.lexsort((row_id, unnamed, ~score, key))
        key = key[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        kept = order[rank < self.k]
        self.key, self.score, self.id, self.unnamed = key[rank < self.k], score[kept], row_id[kept], unnamed[kept]
        full = rank[rank < self.k] == self.k - 1
        self.least[self.key[full]] = self.score[full]


def _scan(rows: DataFrame, anchors, same: bool, k: int) -> DataFrame:
    """Best rows of every task for every slot: ``anchor, slot, score, id``.

    ``anchors`` is a broadcast of (ids, labels, vectors, lows, highs): slot j of an anchor holds the scores in
    ``highs[j + 1] < score <= highs[j]`` that are at least ``lows``; ``highs`` fall from slot to slot.
    """

    def run(batches):
        ids, labels, vectors, lows, highs = anchors.value
        slots = highs.shape[1]
        best = [Best(len(ids[a:a + BLOCK]), slots, k) for a in range(0, len(ids), BLOCK)]
        for batch in batches:
            own_id, own_label = batch.column("id"), batch.column("label").to_numpy()
            unnamed = own_id.is_null().to_numpy(zero_copy_only=False)
            own_id = own_id.fill_null(0).to_numpy()
            own = matrix(batch.column("vector"))
            for r in range(0, len(own), BLOCK):
                part = slice(r, r + BLOCK)
                for n, kept in enumerate(best):
                    some = slice(n * BLOCK, (n + 1) * BLOCK)
                    scores = products(vectors[some], own[part])
                    # A slot that is full takes nothing below its last row.
                    floor = np.maximum(lows[some], kept.least.reshape(-1, slots).min(axis=1))
                    wanted = (scores >= floor[:, None]) & (scores <= highs[some, :1])
                    wanted &= (labels[some, None] == own_label[None, part]) == same
                    if same:
                        wanted &= (ids[some, None] != own_id[None, part]) | unnamed[None, part]
                    i, j = np.nonzero(wanted)
                    if len(i):
                        score = scores[i, j]
                        slot = (score[:, None] <= highs[some][i]).sum(axis=1) - 1
                        kept.add(i, slot, score, own_id[part][j], unnamed[part][j])
        for n, kept in enumerate(best):
            yield pa.RecordBatch.from_arrays([
                pa.array((n * BLOCK + kept.key // slots).astype(np.int32)), pa.array((kept.key % slots).astype(np.int32)),
                pa.array(kept.score), pa.array(kept.id, mask=kept.unnamed)], ["anchor", "slot", "score", "id"])

    found = rows.mapInArrow(run, "anchor int, slot int, score bigint, id bigint")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def limits(scores: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of integers, rounded up or down, without leaving 64 bits."""
    rest = (scores % 100) * percent
    return scores // 100 * percent + (-(-rest // 100) if up else rest // 100)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", anchors_at_once: int = ANCHORS) -> DataFrame:
    """Hard negatives of every positive of every anchor.

    ``vectors`` has bigint ids, labels of any type and vectors of type array<bigint>; ``anchor`` says which rows are
    anchors (rows without an id are none). A row's score is its inner product with the anchor's vector (a shorter one is
    filled with 0, sums end at the ends of 64 bits); higher scores come first, equal ones by smaller id, null ids last.
    The positives of an anchor are its first ``positives`` rows of the same label and another id; for each, the
    first ``negatives`` rows of another label are returned whose score is from ``low`` to ``high`` percent of the
    positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Labels are compared by a 64-bit hash. Rows with a null label or vector, or a null in the vector, take no part. Anchors that repeat a whole row count
    once; repeated rows among the others are rows of their own. Anchors with one id but another label or vector are
    anchors of their own. An anchor without positives gives nothing, so does an empty table.

    The anchors are a stated query set against all rows: in passes of at most ``anchors_at_once`` (and ``ANCHOR_BYTES``
    of vectors) they are sent to every task, and the rows are read where they lie, never shuffled. The first scan keeps
    the best ``positives`` rows per anchor and task. Their upper limits split the scores of an anchor into disjoint
    slots; the second scan keeps the best ``negatives`` rows per slot and task, which Spark merges. As windows overlap, the
    first rows of one are the first of the slots from its upper limit down, those at or above its lower limit. What a
    task sends is bounded by anchors x slots x ``negatives`` whatever it reads.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select(
        col(id_col).cast("bigint").alias("id"), F.xxhash64(col(label_col)).alias("label"), col(vector_col).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), col(label_col).isNull().alias("gone"))
        .where("not gone and vector is not null and forall(vector, x -> x is not null)").drop("gone"), "vectors")
    chosen = rows.where("anchor and id is not null").select("id", "label", "vector").distinct()
    chosen = staged(chosen.withColumn("pass", F.xxhash64("id", "label", "vector", F.lit(1))), "anchors")
    n, width = chosen.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    at_once = max(1, min(anchors_at_once, ANCHOR_BYTES // (8 * max(1, width or 0))))
    passes = -(-n // at_once)
    path = shared_dir(spark, "negatives")
    kind = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, "
            "pass int")
    spark.createDataFrame([], kind).write.partitionBy("pass").parquet(path)
    others = rows.select("id", "label", "vector")
    for i in range(passes):
        taken = chosen.where(F.pmod("pass", F.lit(passes)) == i).orderBy("id", "label", "pass").toArrow()
        ids, own_labels, block = taken["id"].to_numpy(), taken["label"].to_numpy(), matrix(taken["vector"])
        every = np.full((len(ids), 1), MOST)
        sent = spark.sparkContext.broadcast((ids, own_labels, block, np.full(len(ids), LEAST), every))
        first = _scan(others, sent, True, positives).select("anchor", "rank", "score", "id").toArrow()
        place, rank, score = (first[c].to_numpy() for c in ("anchor", "rank", "score"))
        # One slot for each rank; a rank that an anchor lacks is an empty slot.
        tops = np.full((len(ids), positives), LEAST)
        tops[place, rank - 1] = limits(score, high, False)
        least = np.full(len(ids), MOST)
        np.minimum.at(least, place, limits(score, low, True))
        windows = spark.sparkContext.broadcast((ids, own_labels, block, least, tops))
        slots = _scan(others, windows, False, negatives)
        best = slots.groupBy("anchor").agg(F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("unnamed"), "id", "score")),
        ).alias("best"))
        wanted = pa.table({
            "anchor": first["anchor"], "anchor_id": pa.array(ids[place]), "positive_id": first["id"], "positive_score": first["score"],
            "low": limits(score, low, True), "high": limits(score, high, False)})
        inside = F.slice(F.filter("best", lambda b: b["score"].between(F.col("low"), F.col("high"))), 1, negatives)
        found = spark.createDataFrame(wanted).join(best, "anchor").select(
            "anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "negative"))
        found.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
                     "positive_score", F.col("negative.score").alias("negative_score"), F.lit(i).alias("pass")
                     ).write.mode("append").partitionBy("pass").parquet(path)
        sent.destroy()
        windows.destroy()
    return spark.read.schema(kind).parquet(path).drop("pass")
