"""Mix sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.session import staged

WEIGHTS = (5, 2, 1)
# A source gives at most this many times its size.
MOST = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Words each source is to give: ``source, source_size, weight, target``.

    ``sizes`` has one row per source (source, source_size). Sources in code-point order, null last, take ``weights``
    in turn and share the sum of all sizes by them; a target stops at ``most`` times its source, and what is over is
    shared again until none is above. That ends at one level L with target = min(most * size, weight * L): sources
    with a small size for their weight are capped first, so L follows from running sums in that order. Sums are
    integers; the only rounding is the last division. The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("bigint"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    sums = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    # Capped while the level that the sources from here on would share is above the cap.
    shared = sums.withColumn("capped", F.col("left") / F.col("open") >= cap / F.col("weight"))
    first = F.max_by(F.struct("left", "open"), F.when(~F.col("capped"), F.col("open"))).over(everything)
    return shared.withColumn("level", first).select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), cap.cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open")).alias("target"))


def _draw(text: Column) -> Column:
    """Number in [0, 1) from the MD5 of a text: the same in every run and engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row: ``id, source, size, source_size, target, copies, taken``.

    Every document of a source is expected ``target / source_size`` times. Within a source the documents stand in the
    order of their size, then of a hash of the id, then of the id; each begins where the one before ended, the whole
    is moved by one random offset per source, and a document is taken once per integer boundary it crosses. Neighbours
    have nearly equal sizes, so the words taken differ from the target by about one document. Copies are the
    integer or the next integer to the expectation; reruns agree.

    Null text has size 0; null is a source of its own, the last one. A source without words has target 0 and gives
    nothing. Rows that repeat id and text are documents of their own. An empty table gives an empty result.

    Places are counted in three levels, (source), (source, size) and (source, size, part), where the parts are about
    as many as the square root of all rows; so no task orders more than about that many rows of one group.
    """
    base = staged(docs.select(
        col(id_col).alias("id"), col(source_col).alias("source"), n_words(col(text_col)).alias("size"),
        F.xxhash64(col(text_col)).alias("text_hash")), "sizes")
    sizes = staged(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    parts = max(1, math.isqrt(base.count()))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    cells = base.withColumn("part", F.pmod(hashed, F.lit(parts)))

    def offsets(counts: DataFrame, over: list, order: str, name: str) -> DataFrame:
        before = Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))

    by_part = cells.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    by_size = offsets(by_part.groupBy("source", "size").agg(F.sum("n").alias("n")), ["source"], "size", "before_size")
    by_part = offsets(by_part, ["source", "size"], "part", "before_part")
    started = by_part.alias("p").join(by_size.alias("s"), F.expr("p.source <=> s.source and p.size = s.size")).select(
        F.col("p.source").alias("c_source"), F.col("p.size").alias("c_size"), F.col("p.part").alias("c_part"),
        (F.col("before_size") + F.col("before_part")).alias("before"))
    within = Window.partitionBy("source", "size", "part").orderBy(F.col("id").asc_nulls_last(), "text_hash")
    placed = cells.withColumn("place", F.row_number().over(within)).join(
        started, F.expr("source <=> c_source and size = c_size and part = c_part"))
    # One row per source.
    rates = source_targets(sizes.select("source", "source_size"), weights, most).select(
        F.col("source").alias("r_source"), "source_size", "target",
        _draw(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))).alias("offset"),
        F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("rate"))
    rated = placed.join(rates, F.col("source").eqNullSafe(F.col("r_source"))).withColumn("place", F.col("place") + F.col("before"))
    whole = F.floor("rate")
    part = F.col("rate") - whole
    copies = whole + F.floor(part * F.col("place") + F.col("offset")) - F.floor(part * (F.col("place") - 1) + F.col("offset"))
    return rated.withColumn("copies", copies.cast("bigint")).select(
        "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_copies` says, its copies numbered from 1 on.

    Adds the column ``copy`` (underscores in front while the name is taken). Of rows that repeat id, text and source
    one stands for all, with the copies of all.
    """
    copy, marked, times, key_id, key_hash, key_source = (
        fresh(docs, c) for c in ("copy", "text_hash", "copies", "key_id", "key_hash", "key_source"))
    taken = mix_copies(docs, weights, most, seed, id_col, text_col, source_col).groupBy(
        F.col("id").alias(key_id), F.col("text_hash").alias(key_hash), F.col("source").alias(key_source)).agg(
        F.sum("copies").alias(times), (F.count(F.lit(1)) > 1).alias("__again"))
    taken = staged(taken.where(col(times) > 0), "taken")
    own = docs.withColumn(marked, F.xxhash64(col(text_col)))

    def matching(keys):
        return own.join(keys.drop("__again"), col(id_col).eqNullSafe(col(key_id)) & (col(marked) == col(key_hash))
                        & col(source_col).eqNullSafe(col(key_source)))

    found, repeated = matching(taken.where("not __again")), taken.where("__again")
    if not repeated.isEmpty():
        found = found.unionByName(matching(repeated).dropDuplicates([id_col, marked, source_col]))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), col(times)))).select(
        *[col(c) for c in docs.columns], col(copy))
