"""Exact cosine search over embeddings for a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.topk import first_per_group
from corpuscope.session import staged
from corpuscope.sources.artifacts import KEYS, LEVELS, all_levels

# Query vectors multiplied with a batch at a time, and those (and their bytes) that one pass over the artifacts looks for.
QUERIES_PER_STEP = 256
QUERIES_AT_ONCE = 4096
QUERY_BYTES = 1 << 26
# Distances are compared at this many decimals; equal ones are ordered by these columns.
DISTANCE_DECIMALS = 9
TIES = ["level", "file_path", "name", "parent_class", "repo_id", "position"]


def _matrix(column: pa.ChunkedArray, what: str, width: int | None = None) -> np.ndarray:
    """Vectors of equal length as rows."""
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    width = width if width is not None else (int(lengths[0]) if len(lengths) else 0)
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"{what} must all have {width} dimensions")
    return values.reshape(len(lengths), width)


def _nearest(k: int, sent):
    """Arrow function: the ``k`` artifacts of a task nearest to each query. A task holds one batch and the lists."""

    def run(batches):
        queries = sent.value
        asked = _matrix(queries["embedding"], "query vectors")
        lengths = np.sqrt((asked * asked).sum(axis=1))
        own_repo, own_level = queries["repo_id"].to_pylist(), queries["level"].to_pylist()
        farthest = np.full(len(asked), np.inf)  # of the lists that are full
        best, fresh, waiting = None, [], 0

        def merged():
            """The lists with what has come since; equal distances go by the other columns."""
            rows = pa.concat_tables([*([best] if best is not None else []), *fresh])
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("query", "key", *TIES)]))
            query = rows["query"].to_numpy()
            kept = np.arange(len(query)) - np.searchsorted(query, query) < k
            rows = rows.filter(pa.array(kept))
            query, key = rows["query"].to_numpy(), rows["key"].to_numpy()
            full = np.bincount(query, minlength=len(asked)) == k
            last = np.cumsum(np.bincount(query, minlength=len(asked))) - 1
            farthest[full] = key[last[full]]
            return rows

        for batch in batches:
            rows = _matrix(pa.chunked_array([batch.column("embedding")]), "embeddings", asked.shape[1])
            norms = np.sqrt((rows * rows).sum(axis=1))
            repos, levels = (np.array(batch.column(c).to_pylist(), object) for c in ("repo_id", "type"))
            keys = pa.Table.from_batches([batch.select(["level", *KEYS])])
            for i in range(0, len(asked), QUERIES_PER_STEP):
                part = slice(i, i + QUERIES_PER_STEP)
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosine = (rows @ asked[part].T) / (norms[:, None] * lengths[None, part])
                found = np.round(1.0 - cosine, DISTANCE_DECIMALS) + 0.0
                # Vectors of length zero have no distance; they come last.
                key = np.where(np.isnan(found), np.finfo(float).max, found)
                for j, (repo, level) in enumerate(zip(own_repo[part], own_level[part])):
                    if repo is not None:
                        key[repos != repo, j] = np.inf
                    if level != "all":
                        key[levels != level, j] = np.inf
                at = min(k, len(rows)) - 1
                bound = np.minimum(np.partition(key, at, axis=0)[at], farthest[part]) if len(rows) else farthest[part]
                r, q = np.nonzero((key <= bound) & (key < np.inf))
                if len(r):
                    near = keys.take(pa.array(r)).append_column("query", pa.array((q + i).astype(np.int64)))
                    fresh.append(near.append_column("key", pa.array(key[r, q])).append_column("distance", pa.array(found[r, q])))
                    waiting += len(r)
            if waiting > max(1 << 16, 2 * k * len(asked)):
                best, fresh, waiting = merged(), [], 0
        if best is not None or fresh:
            best = merged()
            out = best.append_column("query_id", queries["query_id"].take(best["query"]))
            yield from out.select(["level", *KEYS, "distance", "query_id"]).combine_chunks().to_batches()

    return run


def query_table(queries: DataFrame) -> DataFrame:
    """``query_id, repo_id, level, embedding``; without a repository or level all are searched. NULL vectors find nothing."""
    def given(name, default):
        return F.col(name).cast("string") if name in queries.columns else F.lit(default).cast("string")

    return queries.where(F.col("embedding").isNotNull()).select(
        "query_id", given("repo_id", None).alias("repo_id"), F.coalesce(given("level", "all"), F.lit("all")).alias("level"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def vector_topk(artifacts: DataFrame, queries: DataFrame, k: int = 20, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine distance.

    ``queries``: query_id, embedding and, where wanted, repo_id and level. The queries are sent to every task, up to
    ``queries_at_once`` (and QUERY_BYTES of vectors) in one pass; the artifacts are read where they lie, a batch at a
    time, never shuffled, and each task sends at most ``k`` narrow rows per query on. Texts stay out of the Python
    side; :func:`with_content` adds them to the winners. Rows without an embedding are not indexed; vectors of length
    zero have the distance NaN and come last.
    """
    spark = artifacts.sparkSession
    asked = staged(query_table(queries), "queries")
    id_type = asked.schema["query_id"].dataType.simpleString()
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("type")).cast("int").alias("level")
    rows = artifacts.where(F.col("embedding").isNotNull()).select(level, *KEYS, "embedding")
    schema = ("level int, repo_id string, type string, file_path string, parent_class string, name string, position bigint, "
              f"distance double, query_id {id_type}")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    passes = -(-n // max(1, min(queries_at_once, QUERY_BYTES // (8 * max(1, width or 0)))))
    near = None
    for i in range(passes):
        sent = spark.sparkContext.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow())
        found = rows.mapInArrow(_nearest(k, sent), schema) if sent.value.num_rows else spark.createDataFrame([], schema)
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], schema)
    best = first_per_group(near, ["query_id"], ["distance", *TIES], k, rank="rank", spread_by=KEYS)
    return best.select("query_id", "rank", *KEYS, "distance")


def vector_search(levels: dict[str, DataFrame], queries: DataFrame, k: int = 20, **how) -> DataFrame:
    """Nearest rows over all levels, or the one that a query names.

    The k nearest of the stacked levels are the k nearest of the three per-level lists, so one pass is enough.
    """
    return vector_topk(all_levels(levels), queries, k, **how)


def with_content(results: DataFrame, artifacts: DataFrame, columns) -> DataFrame:
    """Add artifact columns to search results, one row per result: (query_id, rank) and the key tell them apart.

    Of artifacts with the same key the one with the smallest texts stands for all. Spark picks the join by the sizes it
    measures.
    """
    wanted = artifacts.select(*KEYS, *columns)
    return first_per_group(results.join(wanted, KEYS, "left"), ["query_id", *KEYS], [F.col(c).asc_nulls_last() for c in columns], 1)


def to_results(hits: DataFrame) -> DataFrame:
    """Score 1 − distance and the common result columns; missing text becomes ''."""
    def text(c):
        return F.coalesce(F.col(c), F.lit("")) if c in hits.columns else F.lit("")

    return hits.select(
        "query_id",
        F.col("rank"),
        *KEYS,
        (F.lit(1.0) - F.col("distance")).alias("relevance_score"),
        text("enhanced_content").alias("enhanced_content"),
        F.lit("").alias("match_reason"),
        text("rich_metadata").alias("rich_metadata"),
    )
