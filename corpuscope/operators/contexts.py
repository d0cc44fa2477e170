"""Contexts by reference: messages are stored once, in blocks, and the context of a turn is only written out where it is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.topk import positions

# Messages of a block, and positions of a cell that places are counted over.
WIDTH = 64
CELL = 1000


def _join(left: DataFrame, right: DataFrame, names, how: str) -> DataFrame:
    """Join on columns of both, where NULL is a value like any other; the columns of ``left`` stay."""
    other = {c: f"__of_{i}" for i, c in enumerate(names)}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in other.items()])
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


def context_blocks(turns: DataFrame, keys, position: str = "turn", text: str = "text") -> DataFrame:
    """``*keys, block, positions, messages``: the turns of a conversation in order, ``WIDTH`` in a block, blocks from 0.

    Each message stands in one block, so the size is that of the messages. A turn is its place in a block, its context all
    blocks before and the block up to it. Turns of one position are in order of their texts; NULL messages keep their place.
    """
    keys = list(keys)
    cells = turns.select(*keys, F.col(position).alias("__position"), F.col(text).alias("__text"), F.floor(F.col(position) / CELL).alias("__cell"))
    placed = positions(cells, keys, ["__cell"], ["__position", "__text"], "__at")
    block = F.floor((F.col("__at") - 1) / WIDTH).cast("bigint").alias("block")
    turn = F.struct(F.col("__at").alias("at"), F.col("__position").alias("position"), F.col("__text").alias("text"))
    blocks = placed.groupBy(*keys, block).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    return blocks.select(*keys, "block", F.col("__turns.position").alias("positions"), F.col("__turns.text").alias("messages"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored blocks; None before the first turn is stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def store_contexts(turns: DataFrame, path: str, keys, position: str = "turn", text: str = "text") -> None:
    """Append turns to the stored blocks; turns whose position a conversation holds already are left out, so a run may be repeated.

    New turns come behind the stored ones of their conversation, in blocks of their own: nothing stored is read but keys, block
    numbers and positions, and nothing is written again.
    """
    keys = list(keys)
    stored = read_blocks(turns.sparkSession, path)
    if stored is None:
        context_blocks(turns, keys, position, text).write.mode("append").parquet(path)
        return
    held = stored.select(*keys, F.explode("positions").alias(position))
    new = turns.select(*keys, position, text)
    blocks = context_blocks(_join(new, held, [*keys, position], "left_anti"), keys, position, text)
    last = stored.groupBy(*keys).agg(F.max("block").alias("__last"))
    later = (F.col("block") + F.coalesce("__last", F.lit(-1)) + 1).alias("block")
    _join(blocks, last, keys, "left").select(*keys, later, "positions", "messages").write.mode("append").parquet(path)


def contexts_at(asked: DataFrame, blocks: DataFrame, keys, position: str = "turn", separator: str = "\n", own: bool = True) -> DataFrame:
    """``*keys, position, context``: the contexts of the asked turns, all messages up to each (without ``own`` those before it).

    An asked turn that is not stored has no row, one that is asked or stored several times has one, up to its last place. Only
    asked turns are written out: each meets the blocks it refers to by conversation and number, and its pieces are put
    together in their order. A context without messages is NULL.
    """
    keys = list(keys)
    names = [*keys, position]
    turns = asked.select(*names).distinct()
    places = blocks.select(*keys, F.col("block").alias("__own"), F.posexplode("positions").alias("__place", position))
    found = _join(turns, places, names, "inner").groupBy(*names).agg(F.max(F.struct("__own", "__place")).alias("__at"))
    needed = found.select(*names, "__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__at.__own"))).alias("block"))
    upto = F.col("__at.__place") + F.lit(1 if own else 0)
    part = F.when(F.col("block") < F.col("__at.__own"), F.col("messages")).otherwise(F.slice("messages", F.lit(1), upto))
    met = _join(needed, blocks.select(*keys, "block", "messages"), [*keys, "block"], "inner").select(
        *names, F.col("block").alias("__block"), part.alias("__messages"))
    piece = met.select(*names, F.struct("__block", F.array_compact("__messages").alias("m")).alias("__piece"))
    whole = piece.groupBy(*names).agg(F.flatten(F.transform(F.sort_array(F.collect_list("__piece")), lambda p: p.m)).alias("__all"))
    return whole.select(*names, F.when(F.size("__all") > 0, F.array_join("__all", separator)).alias("context"))
