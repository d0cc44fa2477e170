"""Capped histories, expiring sessions, running context and session state, in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.operators.topk import first_per_group, positions

# Messages kept per key, seconds until a session ends.
HISTORY_CAP = 50
SESSION_TTL = 604800


def capped_history(events: DataFrame, keys, order, n: int = HISTORY_CAP, hot_keys: bool = False) -> DataFrame:
    """Newest ``n`` events of each key; ``recency`` is 1 for the newest.

    The limit is applied in every task before the exchange, so a hot key sends n rows per task. With ``hot_keys`` the
    rows of a key are also split over several tasks first, at the price of a second exchange for all keys.
    """
    newest = [F.desc(c) for c in order]
    return first_per_group(events, keys, newest, n, rank="recency", spread_by=order if hot_keys else ())


def sessions(events: DataFrame, keys, ts: str = "ts", gap_seconds: int = SESSION_TTL) -> DataFrame:
    """Sessions that end ``gap_seconds`` after their last event.

    Events of a key inside one time cell as wide as the gap always share a session, so they are first reduced to one
    row per (key, cell) with map-side aggregation. Only those few rows per key are ordered, whatever the size of the
    key. A pause of exactly the gap still belongs to the session, as in the streaming variant.
    """
    return session_rows(merge_spans(event_spans(events, keys, ts, gap_seconds), keys, gap_seconds), keys, gap_seconds)


def event_spans(events: DataFrame, keys, ts: str = "ts", gap_seconds: int = SESSION_TTL) -> DataFrame:
    """Events reduced to one span per key and time cell as wide as the gap: keys, first, last (microseconds), n."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    return (
        events.where(F.col(ts).isNotNull())
        .select(*keys, micros.alias("t"), (micros - F.pmod(micros, F.lit(gap))).alias("cell"))
        .groupBy(*keys, "cell")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("cell")
    )


def merge_spans(spans: DataFrame, keys, gap_seconds: int = SESSION_TTL) -> DataFrame:
    """Spans of a key that are not further apart than the gap, or overlap, put together."""
    in_time = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") - reached > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = spans.withColumn("opens", opens).withColumn(
        "__no", F.sum("opens").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__no").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__no")


def session_rows(spans: DataFrame, keys, gap_seconds: int = SESSION_TTL) -> DataFrame:
    """Sessions from merged spans, numbered per key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("bigint")
    return spans.select(
        *keys,
        number.alias("session_no"),
        F.timestamp_micros("first").alias("created_at"),
        F.timestamp_micros("last").alias("last_activity"),
        F.timestamp_micros(F.col("last") + gap_seconds * 1_000_000).alias("expires_at"),
        F.col("n").alias("events"),
    )


def live_history(events: DataFrame, keys, order, ts: str = "ts", n: int = HISTORY_CAP, gap_seconds: int = SESSION_TTL,
                 now=None) -> DataFrame:
    """Newest ``n`` events of each key since its list last ran out; with ``now`` only lists that have not run out by then.

    The events are capped first, so only ``n`` rows per key meet the last session of their key.
    """
    last = sessions(events, keys, ts, gap_seconds).groupBy(*keys).agg(
        F.max("created_at").alias("__opened"), F.max("expires_at").alias("__ends")
    )
    kept = capped_history(events, keys, order, n).join(last, list(keys))
    current = F.col(ts).cast("timestamp") >= F.col("__opened")
    return kept.where(current if now is None else current & (F.col("__ends") > now)).drop("__opened", "__ends")


def live_sessions(found: DataFrame, now) -> DataFrame:
    """Sessions that have not ended at the given time."""
    return found.where(F.col("expires_at") > now)


def list_keys(events: DataFrame, keys, n: int = HISTORY_CAP) -> DataFrame:
    """Keys that have a history, with the length of the capped list."""
    return events.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(n)).cast("bigint").alias("history_count"))


def delete_keys(df: DataFrame, gone: DataFrame, keys) -> DataFrame:
    """Rows of keys that are not deleted."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_history(store: DataFrame, updates: DataFrame, keys, emptied: DataFrame | None = None) -> DataFrame:
    """History with the keys of ``updates`` rewritten; keys in ``emptied`` end without one."""
    gone = updates.select(*keys) if emptied is None else updates.select(*keys).unionByName(emptied.select(*keys))
    return delete_keys(store, gone, keys).unionByName(updates.select(*store.columns))


def merge_state(updates: DataFrame, keys, seq: str, fields) -> DataFrame:
    """Last written value of every field per key; an update leaves the fields it does not carry."""
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return updates.groupBy(*keys).agg(*latest, F.max(seq).alias("last_update"))


def session_status(state: DataFrame, histories: DataFrame, keys, columns=("status", "last_activity", "current_stage")) -> DataFrame:
    """Status columns of every session and the length of its history."""
    counts = histories.groupBy(*keys).agg(F.count(F.lit(1)).alias("query_count"))
    return state.select(*keys, *columns).join(counts, list(keys), "left").withColumn(
        "query_count", F.coalesce("query_count", F.lit(0))
    )


# Positions per block when a conversation is spread.
BLOCK = 1000


def _numbered(turns: DataFrame, keys, position: str, width: int) -> DataFrame:
    """Turns with their place in the conversation (``__at``, from 0) and its block, whatever the gaps between positions."""
    cell = turns.withColumn("__cell", F.floor(F.col(position) / BLOCK))
    placed = positions(cell, list(keys), ["__cell"], [position], "__at").drop("__cell")
    return placed.withColumn("__at", F.col("__at") - 1).withColumn("__block", F.floor(F.col("__at") / width))


def _listed(column: str, frame, separator: str):
    """Messages of a frame, joined; NULL where it has none."""
    found = F.collect_list(column).over(frame)
    return F.when(F.size(found) > 0, F.array_join(found, separator))


def _earlier(turns: DataFrame, keys, position: str, text: str, separator: str, history: int | None) -> DataFrame:
    """Adds ``__earlier``: the messages before each turn, joined; NULL where there are none.

    A conversation of any length is spread over blocks of places. With ``history`` each block is led by that many turns
    ahead of it; without, the texts of all earlier blocks are joined to its turns.
    """
    keys = list(keys)
    width = BLOCK if history is None else max(BLOCK, 20 * history)
    placed = _numbered(turns, keys, position, width)
    in_block = Window.partitionBy(*keys, "__block").orderBy("__at")
    if history is not None:
        own = F.struct(F.col("__block").alias("block"), F.lit(True).alias("own"))
        led = F.struct((F.col("__block") + 1).alias("block"), F.lit(False).alias("own"))
        copies = F.when(F.col("__at") % width >= width - history, F.array(own, led)).otherwise(F.array(own))
        spread = placed.withColumn("__copy", F.explode(copies)).withColumn("__block", F.col("__copy.block"))
        found = spread.withColumn("__earlier", _listed(text, in_block.rowsBetween(-history, -1), separator))
        return found.where("__copy.own").drop("__copy", "__block", "__at")
    inside = placed.withColumn("__inside", _listed(text, in_block.rowsBetween(Window.unboundedPreceding, -1), separator))
    messages = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct("__at", F.col(text).alias("m")))))
    blocks = placed.groupBy(*keys, "__block").agg(F.array_join(F.transform(messages, lambda x: x["m"]), separator).alias("t"), F.size(messages).alias("n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("t", F.when(F.col("n") > 0, F.col("t"))).withColumn("__ahead", _listed("t", before, separator))
    names = {c: f"__of_{i}" for i, c in enumerate([*keys, "__block"])}
    ahead = blocks.where("__ahead is not null").select(*[F.col(c).alias(n) for c, n in names.items()], "__ahead")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    joined = inside.join(ahead, same, "left").drop(*names.values())
    return joined.withColumn("__earlier", F.concat_ws(separator, "__ahead", "__inside")).withColumn(
        "__earlier", F.when(F.col("__ahead").isNotNull() | F.col("__inside").isNotNull(), F.col("__earlier"))
    ).drop("__ahead", "__inside", "__block", "__at")


def running_context(turns: DataFrame, keys, position: str = "turn", text: str = "text", history: int | None = None) -> DataFrame:
    """Per turn: all earlier messages and itself, one per line; with ``history`` at most so many earlier ones.

    The whole context of every turn grows with the square of a conversation; :func:`last_context` gives one row each.
    """
    found = _earlier(turns, keys, position, text, "\n", history)
    return found.withColumn("context", F.concat_ws("\n", "__earlier", text)).drop("__earlier")


def last_context(turns: DataFrame, keys, position: str = "turn", text: str = "text") -> DataFrame:
    """Per conversation: number of messages and all of them in order, one per line."""
    message = F.when(F.col(text).isNotNull(), F.struct(F.col(position).alias("at"), F.col(text).alias("m")))
    listed = F.sort_array(F.collect_list(message))
    return turns.groupBy(*keys).agg(F.count(text).alias("messages"), F.array_join(F.transform(listed, lambda x: x["m"]), "\n").alias("context"))


# Texts of the follow-up task.
FOLLOWUP = ("\n\n --- the above are the previously used user_queries. ---", "\n Additional requirements: ",
            "\n\n Please create a new approach considering this feedback.")


def followup_context(turns: DataFrame, keys, position: str = "turn", text: str = "text", history: int | None = None) -> DataFrame:
    """Per turn: all earlier messages (with ``history`` at most so many) joined by commas, then the message as an additional requirement."""
    found = _earlier(turns, keys, position, text, ", ", history)
    task = F.concat(F.coalesce("__earlier", F.lit("")), F.lit(FOLLOWUP[0]), F.lit(FOLLOWUP[1]), F.coalesce(text, F.lit("")), F.lit(FOLLOWUP[2]))
    return found.withColumn("developer_task", task).drop("__earlier")
