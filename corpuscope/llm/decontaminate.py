"""Benchmark decontamination by winnowing: shared fingerprints, joined and extended to all words of shared passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.sieve import BITS, bitmap, passes
from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import ALNUM, documents_words, grams
from corpuscope.session import staged

# Words of a window: a run of so many words that both sides have is always found.
WINDOW = 10
# Words of a fingerprint; the smallest of WINDOW - GRAM + 1 neighbouring ones is kept.
GRAM = 6
REACH = WINDOW - GRAM
# Words around a fingerprint that can share a window with it.
AROUND = 2 * REACH + GRAM

FOUND = "array<struct<pos:bigint,len:int,fp:bigint,around:binary>>"
FOUND_ARROW = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int32()), ("fp", pa.int64()), ("around", pa.binary())]))


def winnow(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: in every window of WINDOW words the smallest gram, of equal ones the last.

    ``ends`` has, for each word, the end of its document. A window has the same grams wherever it stands, so two
    texts that share one also share its fingerprint.
    """
    fps = grams(hashes, GRAM)
    width = WINDOW - GRAM + 1
    starts = len(fps) - width + 1
    if starts <= 0:
        return np.zeros(0, np.int64)
    best = fps[:starts].copy()
    place = np.zeros(starts, np.int64)
    for i in range(1, width):
        here = fps[i:i + starts]
        lower = here <= best
        best[lower] = here[lower]
        place[lower] = i
    first = np.arange(starts)
    whole = first + WINDOW <= ends[:starts]
    chosen = np.zeros(len(hashes), bool)
    chosen[(first + place)[whole]] = True
    return np.flatnonzero(chosen)


def _found(sieve, short_lengths, outside: int):
    """Arrow function: word count and fingerprints of each text; with a sieve only those that pass it."""
    long_salt = np.uint64(0xA5A5A5A5A5A5A5A5)

    def run(batches):
        for batch in batches:
            for first, hashes, bounds in documents_words(batch.column("text"), ALNUM):
                counts = np.diff(bounds)
                ends = np.repeat(bounds[1:], counts)
                begins = np.repeat(bounds[:-1], counts)
                parts = []
                chosen = winnow(hashes, ends)
                if len(chosen):
                    parts.append((chosen, np.zeros(len(chosen), np.int32), grams(hashes, GRAM)[chosen] ^ long_salt))
                for n in short_lengths:
                    fps = grams(hashes, n) ^ np.uint64(n)
                    place = np.flatnonzero(np.arange(len(fps)) + n <= ends[:len(fps)])
                    if outside:  # an item of fewer words is one window
                        place = place[(counts[np.searchsorted(bounds, place, side="right") - 1] == n)]
                    parts.append((place, np.full(len(place), n, np.int32), fps[place]))
                pos, size, fps = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
                                  for i, t in ((0, np.int64), (1, np.int32), (2, np.uint64)))
                if sieve is not None and len(fps):
                    keep = passes(sieve, fps >> np.uint64(64 - BITS))
                    pos, size, fps = pos[keep], size[keep], fps[keep]
                order = np.argsort(pos, kind="stable")
                pos, size, fps = pos[order], size[order], fps[order]
                around = np.full((len(pos), AROUND), outside, np.uint64)
                for i in range(AROUND):
                    at = pos + (i - REACH)
                    inside = (at >= begins[pos]) & (at < ends[pos])
                    around[inside, i] = hashes[at[inside]]
                packed = pa.Array.from_buffers(pa.binary(), len(pos), [
                    None, pa.py_buffer(np.arange(0, 8 * AROUND * (len(pos) + 1), 8 * AROUND, dtype=np.int32)),
                    pa.py_buffer(around.tobytes())])
                values = pa.StructArray.from_arrays(
                    [pa.array(pos - begins[pos] if len(pos) else pos), pa.array(size), pa.array(fps.view(np.int64)), packed],
                    names=["pos", "len", "fp", "around"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pos, bounds).astype(np.int32)), values)
                yield pa.record_batch([batch.column("id").slice(first, len(counts)), pa.array(counts.astype(np.int64)),
                                       lists.cast(FOUND_ARROW)], names=["id", "n_words", "found"])

    return run


def _extend(batches):
    """Longest equal run through each pair of fingerprints, within the words around them."""
    for batch in batches:
        def words(name):
            c = batch.column(name)
            return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), AROUND)

        if batch.num_rows == 0:
            continue
        same = words("around") == words("item_around")
        size = batch.column("len").to_numpy()
        pos = batch.column("pos").to_numpy()
        left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, REACH:], axis=1).sum(axis=1)
        long = size == 0
        start = np.where(long, pos - left, pos)
        end = np.where(long, pos + right, pos + size)
        real = np.where(long, (right >= GRAM) & (left + right >= WINDOW), right >= size)
        yield pa.record_batch([batch.column("row"), batch.column("context"), pa.array(start), pa.array(end)],
                              names=["row", "context", "start", "end"]).filter(pa.array(real))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document that lie in a passage shared with a benchmark item.

    Words are runs of letters A-Z (as a-z), digits and non-ASCII characters. A window is WINDOW consecutive words of an
    item; an item of fewer words, but not none, is one window. Returns per row of ``docs``: id, n_words, n_hit (words
    inside any occurrence of a window), n_items, items (their ids as sorted strings). Null and empty texts have no
    words and are never hit; null item ids and items without words count nowhere; an item given twice counts once, also
    when its texts differ. Rows that repeat id and text are judged one by one. With an empty benchmark nothing is hit.

    Both sides are winnowed (fingerprints of GRAM words, at least one in every window; all runs of n words where an item
    has only n), so every shared window is found. Fingerprints of documents first pass a bitmap of fixed size made
    from the items', then meet those in an ordinary join; each pair is extended over the words around it. Words are
    compared by 64-bit hashes. Equal fingerprints with equal words around them, as common passages have, are joined
    once whatever number of items they stand in.
    """
    items = benchmark.where(col(item_col).isNotNull()).select(
        col(item_col).cast("string").alias("id"), col(item_text_col).alias("text"))
    lengths = range(1, WINDOW)
    prints = staged(items.mapInArrow(_found(None, lengths, 1), f"id string, n_words bigint, found {FOUND}")
                    .select("id", F.explode("found").alias("f")).select("id", "f.len", "f.fp", "f.around").distinct(), "items")
    context = F.xxhash64("len", "fp", "around")
    contexts = prints.select("len", "fp", F.col("around").alias("item_around"), context.alias("context")).distinct()
    of_item = prints.select(F.col("id").alias("item"), context.alias("context")).distinct()
    short = [r[0] for r in prints.where("len > 0").select("len").distinct().collect()]  # at most WINDOW - 1 numbers
    sieve = bitmap(prints.select(F.shiftrightunsigned("fp", 64 - BITS).alias("slot")))
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    scanned = staged(own.mapInArrow(_found(sieve, sorted(short), 0), f"id {id_type}, n_words bigint, found {FOUND}")
                     .withColumn("row", F.monotonically_increasing_id()), "scanned")
    pairs = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select(
        "row", "f.pos", "f.len", "f.fp", "f.around").join(contexts, ["len", "fp"])
    spans = staged(pairs.mapInArrow(_extend, "row bigint, context bigint, start bigint, end bigint"), "spans")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    hits = spans.select("row", "start", "end").distinct().select(
        "row", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)).alias("new")).groupBy("row").agg(
        F.sum("new").alias("n_hit"))
    named = spans.select("row", "context").distinct().join(of_item, "context").select("row", "item").distinct().groupBy(
        "row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    return scanned.select("row", "id", "n_words").join(hits.join(named, "row"), "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit, all columns as they were."""
    hashed = docs.select(F.struct(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h")).alias("key"), col(text_col).alias("text"))
    bad = contamination(hashed, benchmark, "key", "text", item_col, item_text_col).where("n_hit > 0")
    bad_id, bad_hash = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = bad.select(F.col("key.id").alias(bad_id), F.col("key.h").alias(bad_hash)).distinct()
    same = col(id_col).eqNullSafe(col(bad_id)) & (F.xxhash64(col(text_col)) == col(bad_hash))
    return docs.join(bad, same, "left_anti")
