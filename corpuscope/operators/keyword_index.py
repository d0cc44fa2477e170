"""A stored index for keyword search: texts in blocks, and for each run of three bytes the blocks that hold it.

Requests read the lists of their terms' rarest pieces, then only blocks that can hold a term, and of those only blocks whose
bound reaches the best ``k``. What is read is searched exactly, so results equal those of a search without the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.keywords import DENSITY, TEXT, _with_repo, keyword_filter, keyword_hits, keyword_terms
from corpuscope.operators.matching import _BASE, PIECE, _codes, match_terms, pieces_of
from corpuscope.operators.topk import first_per_group
from corpuscope.session import staged
from corpuscope.sources.artifacts import ARTIFACT_COLUMNS, KEYS, SCOPE_LEVEL, all_levels

# Rarest pieces of a term whose lists are read, blocks of a request that are searched first, rows of a list file.
RAREST = 4
FIRST_BLOCKS = 4
LIST_ROWS = 1 << 23
# Bytes of text whose pieces are sorted together, of so many texts that their number fits above a piece; longer texts are
# counted in a table instead.
CHUNK = 1 << 20
TOGETHER = 256
# Stands in the lists for what every block holds: the piece of terms without one.
ANYWHERE = -1
# Bounds are compared with room for the last digits of a sum.
ROOM = 1 + 1e-9
STORED = [c for c in ARTIFACT_COLUMNS if c != "embedding"]
BLOCKS = "block bigint, repo_id string, type string, n_rows bigint"
LISTS = "piece int, block bigint, dense double, bucket int"


@dataclass(frozen=True)
class KeywordIndex:
    """Where an index lies and how it is cut; writers and readers use the same values.

    Folders: ``texts/block=`` (artifacts), ``lists/bucket=`` (piece, block, dense), ``counts`` (piece, blocks) and ``blocks``, which is
    written last, as one file: a block that is not in it is not part of the index.
    """

    root: str
    buckets: int = 64
    block_bytes: int = 1 << 25


def _counted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a long text and how often each stands there, a chunk at a time."""
    pieces, n = np.zeros(0, np.int32), np.zeros(0)
    for at in range(0, len(data), CHUNK):
        parts = [data[at:at + CHUNK + width - 1] for width in range(1, PIECE + 1)]
        own, times = np.unique(np.concatenate([_codes(p, w) for w, p in enumerate(parts, 1) if len(p) >= w]), return_counts=True)
        pieces, place = np.unique(np.concatenate([pieces, own]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, times]))
    return pieces, n


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sum of ``n`` of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _counts(texts: list[np.ndarray]):
    """Yield (width, text, run of bytes, how often it stands there) as arrays, for at most TOGETHER texts.

    Only the longest runs are sorted. A shorter one stands where a run begins with it, or at the end of its text.
    """
    data, sizes = np.concatenate(texts).astype(np.uint32), np.array([len(t) for t in texts])
    owner, ends = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes), np.cumsum(sizes)
    whole = np.flatnonzero(np.arange(len(data)) + PIECE <= np.repeat(ends, sizes))
    key = owner[whole]
    for i in range(PIECE):
        key = (key << 8) | data[whole + i]
    keys, n = np.unique(key, return_counts=True)
    for width in range(PIECE, 0, -1):
        if width < PIECE:
            last = np.flatnonzero(sizes >= width)
            end = last.astype(np.uint32)
            for i in range(width, 0, -1):
                end = (end << 8) | data[ends[last] - i]
            keys, n = _summed(np.concatenate([keys >> 8, end]), np.concatenate([n, np.ones(len(end), n.dtype)]))
        yield width, keys >> (8 * width), keys & ((1 << 8 * width) - 1), n


def _dense(texts) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of (text, words) and, of each, its largest count per word in a text; texts without words count as 0."""
    found, many = [], []
    waiting: list[tuple[np.ndarray, int]] = []

    def flush():
        if waiting:
            words = np.array([w for _, w in waiting])
            for width, owner, code, n in _counts([d for d, _ in waiting]):
                found.append(code.astype(np.int32) + _BASE[width])
                many.append(np.where(words[owner] > 0, n / np.maximum(words[owner], 1), 0.0))
        waiting.clear()

    size = 0
    for text, words in texts:
        data = np.frombuffer(text, np.uint8)
        if len(data) > CHUNK:
            pieces, n = _counted(data)
            found.append(pieces)
            many.append(n / words if words else np.zeros(len(n)))
            found, many = ([x] for x in _largest(found, many))
            continue
        waiting.append((data, words))
        size += len(data)
        if size >= CHUNK or len(waiting) == TOGETHER:
            flush()
            size = 0
    flush()
    return _largest(found, many)


def _largest(found, many) -> tuple[np.ndarray, np.ndarray]:
    """Each piece once, with its largest value."""
    if not found:
        return np.zeros(0, np.int32), np.zeros(0)
    pieces, values = np.concatenate(found), np.concatenate(many)
    order = np.argsort(pieces)
    pieces, values = pieces[order], values[order]
    first = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1])) if len(pieces) else np.zeros(0, np.int64)
    return pieces[first], np.maximum.reduceat(values, first) if len(first) else values


def _list_rows(batches):
    """Arrow function: (piece, block, dense) of texts that come block by block; a task holds the pieces of one block.

    A block whose texts come in several runs gives rows for each.
    """
    now, found, many = None, [], []

    def rows():
        pieces, dense = _largest([*found, np.array([ANYWHERE], np.int32)], [*many, np.array([np.inf])])
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(np.full(len(pieces), now), pa.int64()), pa.array(dense)],
                                         ["piece", "block", "dense"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)) if len(blocks) else []
        start = 0
        for end in ends:
            if now is not None and blocks[start] != now:
                yield from rows()
                found, many = [], []
            now = blocks[start]
            part = batch.slice(start, end - start)
            counted = ((t.as_buffer(), len(t.as_py().split())) for t in part.column("enhanced") if t.is_valid)
            # The second text decides who is found, not how high.
            shown = ((t.as_buffer(), 0) for t in part.column("original") if t.is_valid)
            pieces, dense = _dense(chain(counted, shown))
            found, many = ([x] for x in _largest([*found, pieces], [*many, dense]))
            start = end
    if now is not None:
        yield from rows()


def _lowered(rows: DataFrame) -> dict[str, Column]:
    """The texts as searches see them: lower case, the second only where it differs."""
    original = F.when(~F.col("original_content").eqNullSafe(F.col("enhanced_content")), F.lower("original_content"))
    return {"__enhanced": F.lower("enhanced_content"), "__original": original}


def _placed(rows: DataFrame, index: KeywordIndex, batch: str) -> DataFrame:
    """Rows with their block."""
    size = F.lit(64) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("enhanced_content", "original_content"))
    wanted = rows.groupBy(F.col("repo_id").alias("__repo"), F.col("type").alias("__type")).agg(
        F.ceil(F.sum(size.cast("bigint")) / F.lit(index.block_bytes)).alias("__n"))
    # One narrow row per repository and level, of a size that is known, so that no text moves to meet it.
    dealt = rows.join(staged(wanted, "wanted"), (F.col("repo_id") == F.col("__repo")) & (F.col("type") == F.col("__type")))
    number = F.pmod(F.xxhash64(*KEYS), F.col("__n"))
    return dealt.withColumn("block", F.xxhash64(F.lit(batch), "repo_id", "type", number)).select("block", *STORED)


def add_to_index(levels: dict[str, DataFrame], index: KeywordIndex) -> None:
    """Add artifacts to an index (a new one where nothing lies there yet); blocks that are there are not touched.

    Rows of a repository and level are dealt by a hash over as many blocks as their bytes ask for, so a large repository is
    many blocks and each is built by one task. The texts are shuffled once, to their blocks; lists are made where they lie,
    and of a block that is read in several parts they are merged. If it fails half-way, readers see nothing of it.
    """
    rows = all_levels(levels).select(*STORED)
    spark = rows.sparkSession
    batch = uuid.uuid4().hex
    placed = _placed(rows, index, batch)
    # A block is one task; equal numbers of two blocks (by chance) would only make them one.
    placed.repartition("block").sortWithinPartitions("block").write.mode("append").partitionBy("block").parquet(f"{index.root}/texts")
    own = placed.groupBy("block", "repo_id", "type").agg(F.count(F.lit(1)).alias("n_rows"))
    own = staged(own, "blocks")
    texts = _texts(spark, index).join(own.where("n_rows > 0").select("block").distinct(), "block", "left_semi").withColumns(_lowered(rows))
    lists = texts.select("block", F.col("__enhanced").alias("enhanced"), F.col("__original").alias("original"))
    lists = lists.mapInArrow(_list_rows, "piece int, block bigint, dense double")
    lists = staged(lists.groupBy("piece", "block").agg(F.max("dense").alias("dense")), "lists")
    bucket = F.pmod(F.xxhash64("piece"), F.lit(index.buckets)).cast("int")
    files = max(1, -(-lists.count() // (index.buckets * LIST_ROWS)))
    spread = F.pmod(F.xxhash64("block"), F.lit(files))
    lists.withColumn("bucket", bucket).repartition("bucket", spread).sortWithinPartitions("bucket", "piece", "block").write.mode(
        "append").partitionBy("bucket").parquet(f"{index.root}/lists")
    lists.groupBy("piece").agg(F.count(F.lit(1)).alias("blocks")).write.mode("append").parquet(f"{index.root}/counts")
    own.coalesce(1).write.mode("append").parquet(f"{index.root}/blocks")


def _texts(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    fields = ", ".join(f"{c} {ARTIFACT_COLUMNS[c]}" for c in STORED)
    return spark.read.schema(f"{fields}, block bigint").parquet(f"{index.root}/texts")


def read_blocks(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    """``block, repo_id, type, n_rows`` of all blocks."""
    return spark.read.schema(BLOCKS).parquet(f"{index.root}/blocks")


@cache
def _pieces(literal: bool):
    """Column function: the pieces every match of a term holds."""

    def run(terms: pa.Array) -> pa.Array:
        own = (pieces_of(t.encode(), literal or not any(c in t for c in "%_\\")) for t in terms.to_pylist())
        return pa.array([pieces.tolist() or [ANYWHERE] for pieces in own], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def term_blocks(spark: SparkSession, index: KeywordIndex, terms: DataFrame, literal: bool = False) -> DataFrame:
    """``term, block, repo_id, type, dense``: blocks that can hold a term, and the most it can count per word of a text there.

    ``terms``: term, lower case. Of each term the lists of its rarest pieces are read, no other bucket of the lists; a term with a
    piece that is nowhere has no block, one without any piece (only wildcards, or empty) has all.
    """
    asked = staged(terms.where("term is not null").select("term").distinct().select("term", _pieces(literal)("term").alias("pieces")), "terms")
    each = asked.select("term", F.size("pieces").alias("of"), F.explode("pieces").alias("piece"))
    counts = spark.read.schema("piece int, blocks bigint").parquet(f"{index.root}/counts")
    counts = counts.join(each.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.sum("blocks").alias("blocks"))
    known = each.join(counts, "piece")
    # Terms whose pieces are all somewhere, by their rarest ones.
    whole = known.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.any_value("of").alias("of")).where("n = of").select("term")
    rare = first_per_group(known.join(whole, "term", "left_semi"), ["term"], ["blocks", "piece"], RAREST)
    bucket = F.pmod(F.xxhash64("piece"), F.lit(index.buckets)).cast("int")
    rare = staged(rare.select("term", "piece", bucket.alias("bucket")), "pieces")
    buckets = [r.bucket for r in rare.select("bucket").distinct().collect()]
    lists = spark.read.schema(LISTS).parquet(f"{index.root}/lists").where(F.col("bucket").isin(buckets))
    met = lists.join(rare, ["bucket", "piece"]).groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.min("dense").alias("dense"))
    needed = rare.groupBy("term").agg(F.count(F.lit(1)).alias("needed"))
    held = met.join(needed, "term").where("n = needed").select("term", "block", "dense")
    return held.join(read_blocks(spark, index), "block").select("term", "block", "repo_id", "type", "dense")


def _read(spark: SparkSession, index: KeywordIndex, blocks: DataFrame) -> DataFrame:
    """Artifacts of some blocks; only their folders are read. ``blocks``: a staged table with ``block`` and ``n_rows``."""
    return _texts(spark, index).join(blocks.where("n_rows > 0").select("block"), "block", "left_semi")


def indexed_filter(spark: SparkSession, index: KeywordIndex, keywords, scope: str = "all", literal: bool = False) -> DataFrame:
    """As ``keyword_filter``: artifacts with any of the keywords in either text, from the blocks that can hold one."""
    level = SCOPE_LEVEL.get(scope, "file")
    terms = spark.createDataFrame([(k.lower(),) for k in keywords], "term string")
    held = term_blocks(spark, index, terms, literal).where(F.lit(level == "all") | (F.col("type") == level))
    blocks = staged(held.select("block", F.lit(1).alias("n_rows")).distinct(), "held")
    rows = _read(spark, index, blocks).where(F.lit(level == "all") | (F.col("type") == level)).select(*STORED)
    return keyword_filter({"file": rows}, keywords, "files", literal)


def indexed_match(spark: SparkSession, index: KeywordIndex, requests: DataFrame, k: int = 20, literal: bool = False) -> DataFrame:
    """As ``keyword_match``, from the index: query_id, keys, texts, relevance_score, match_reason, rank.

    Each request's blocks are ordered by the best score they can hold. The first few are searched, which gives the score of
    its ``k``-th hit so far; of the rest only blocks that can reach that score are read, ties included.
    """
    requests = staged(_with_repo(requests).select("query_id", "repo_id", "keywords", "scope"), "requests")
    asked = staged(keyword_terms(requests), "asked")
    held = term_blocks(spark, index, asked.select("term"), literal).alias("h")
    fits = (F.col("r.repo_id").isNull() | (F.col("r.repo_id") == F.col("h.repo_id"))) & (
        (F.col("r.level") == "all") | (F.col("r.level") == F.col("h.type")))
    bound = F.least(F.sum(F.col("h.dense")) / (F.greatest(F.any_value("r.asked"), F.lit(1)) * F.lit(DENSITY)), F.lit(1.0))
    bounds = staged(held.join(asked.alias("r"), (F.col("h.term") == F.col("r.term")) & fits).groupBy("r.query_id", "h.block").agg(
        bound.alias("bound")), "bounds")
    first = first_per_group(bounds, ["query_id"], [F.desc("bound"), "block"], FIRST_BLOCKS).select("block", F.lit(1).alias("n_rows"))
    first = staged(first.distinct(), "first")
    terms = asked.select(F.lit(TEXT).alias("kind"), "term")

    def hits_in(blocks):
        rows = _read(spark, index, blocks)
        return staged(match_terms(rows.withColumns(_lowered(rows)), KEYS, {TEXT: ["__enhanced", "__original"]}, terms, literal), "hits")

    hits = hits_in(first)
    lowest = keyword_hits(requests, hits, k).where(F.col("rank") == k).select(
        F.col("query_id").alias("__query"), F.col("relevance_score").alias("least"))
    reach = bounds.join(lowest, F.col("query_id") == F.col("__query"), "left").where(F.col("bound") * ROOM >= F.coalesce("least", F.lit(0.0)))
    more = reach.select("block").distinct().join(first.select("block"), "block", "left_anti").select("block", F.lit(1).alias("n_rows"))
    more = staged(more, "more")
    best = staged(keyword_hits(requests, hits.unionByName(hits_in(more)), k), "best")
    texts = _read(spark, index, staged(first.unionByName(more), "searched")).select(*KEYS, "enhanced_content", "rich_metadata")
    return best.join(texts, KEYS).select("query_id", *KEYS, "enhanced_content", "rich_metadata", "relevance_score", "match_reason", "rank")
