"""Newest messages per key over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from corpuscope.operators.history import HISTORY_CAP, SESSION_TTL, capped_history
from corpuscope.streaming.tables import BUCKET_BYTES, read_table, table_stream


def capped_history_stream(events: DataFrame, key: str, seq: str, message: str, n: int = HISTORY_CAP) -> DataFrame:
    """State per key with its newest ``n`` messages; every batch emits the current list of the keys it touched.

    ``version`` counts the batches of a key, so a reader keeps the rows of its highest version. The state never
    holds more than ``n`` messages, and rows reach it in Arrow batches that are cut to ``n`` at once.
    """
    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, seqs, texts = state.get if state.exists else (0, [], [])
        kept = pd.DataFrame({"seq": list(seqs), "message": list(texts)})
        for batch in batches:
            kept = pd.concat([kept, batch[["seq", "message"]]], ignore_index=True).sort_values("seq", kind="stable").tail(n)
        state.update((version + 1, [int(s) for s in kept["seq"]], list(kept["message"])))
        yield pd.DataFrame({
            "key": k[0], "version": version + 1, "recency": range(len(kept), 0, -1),
            "seq": kept["seq"].astype("int64"), "message": kept["message"],
        })

    return (
        events.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"),
                      F.col(message).cast("string").alias("message"))
        .groupBy("key")
        .applyInPandasWithState(
            update,
            "key string, version bigint, recency bigint, seq bigint, message string",
            "version bigint, seqs array<bigint>, texts array<string>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


class ExpiringHistory(StatefulProcessor):
    """Newest ``n`` messages of a key since its list last ran out; emits what joins and what leaves the list.

    The state is the list itself, at most ``n`` messages in order of time. A timer stands where the list runs out unless
    something comes: when the watermark passes it, the state is gone. A message may come out of order within the
    watermark, so messages before a pause stay in the state until the watermark has passed that pause.
    """

    def __init__(self, n: int, gap_ms: int):
        self.n, self.gap = n, gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "version bigint, times array<bigint>, seqs array<bigint>, texts array<string>")

    def _current(self, rows: list) -> list:
        """The messages since the last pause."""
        start = 0
        for i in range(1, len(rows)):
            if rows[i][0] - rows[i - 1][0] > self.gap:
                start = i
        return rows[start:]

    def _changes(self, key, version, old: list, new: list) -> pd.DataFrame:
        before, now = set(old), set(new)
        left, came = [r for r in old if r not in now], [r for r in new if r not in before]
        rows = [(key[0], version, c, t, s, m) for c, some in (("drop", left), ("add", came)) for t, s, m in some]
        return pd.DataFrame(rows, columns=["key", "version", "change", "ts_ms", "seq", "message"])

    def _keep(self, version: int, rows: list) -> None:
        times, seqs, texts = zip(*rows)
        self.kept.update((version, list(times), list(seqs), list(texts)))

    def _stored(self) -> tuple[int, list]:
        # One call: there is no value where there is no state.
        stored = self.kept.get()
        if stored is None:
            return 0, []
        version, times, seqs, texts = stored
        return version, list(zip(times, seqs, texts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, old = self._stored()
        new = list(old)
        for batch in rows:
            new += zip(batch["ts_ms"].tolist(), batch["seq"].tolist(), batch["message"].tolist())
            new = sorted(new, key=lambda r: r[:2])[-self.n:]
        mark = timerValues.getCurrentWatermarkInMs()
        while len(new) > 1 and new[0][0] + self.gap < min(new[1][0], mark):
            new = new[1:]
        # The one timer of a key stands behind the last message of its stored list.
        if not old or old[-1][0] != new[-1][0]:
            if old:
                self.handle.deleteTimer(old[-1][0] + self.gap)
            self.handle.registerTimer(new[-1][0] + self.gap)
        self._keep(version + 1, new)
        yield self._changes(key, version + 1, self._current(old), self._current(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, old = self._stored()
        self.kept.clear()
        yield self._changes(key, version + 1, self._current(old), [])

    def close(self) -> None:
        pass


def live_history_stream(events: DataFrame, key: str, seq: str, ts: str, message: str, n: int = HISTORY_CAP,
                        gap_seconds: int = SESSION_TTL, lateness: str = "1 hour") -> DataFrame:
    """Histories that run out on a stream: changes (key, version, change, ts_ms, seq, message), ``change`` being add or drop.

    A list runs out ``gap_seconds`` after its last message (by the watermark, ``lateness`` behind the newest event); its
    key then leaves the state. Only changes are emitted; :func:`current_history` folds them. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = events.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"), F.col(seq).cast("bigint").alias("seq"),
        F.col(message).cast("string").alias("message")).withWatermark("ts", lateness)
    return timed.groupBy("key").transformWithStateInPandas(
        ExpiringHistory(n, gap_seconds * 1000), "key string, version bigint, change string, ts_ms bigint, seq bigint, message string",
        "Append", "EventTime")


def current_history(changes: DataFrame) -> DataFrame:
    """Lists that stand after all changes: key, recency (1 for the newest), seq, message, ts_ms."""
    # The version of a key that is forgotten begins anew, so adds and drops of a message are counted instead.
    sign = F.when(F.col("change") == "add", 1).otherwise(-1)
    there = changes.groupBy("key", "ts_ms", "seq", "message").agg(F.sum(sign).alias("n")).where("n > 0").drop("n")
    newest = Window.partitionBy("key").orderBy(F.desc("ts_ms"), F.desc("seq"))
    return there.withColumn("recency", F.row_number().over(newest).cast("bigint"))


def latest_history(emitted: DataFrame, keys=("key",)) -> DataFrame:
    """Current list of every key from what the stream emitted."""
    newest = emitted.groupBy(*keys).agg(F.max("version").alias("version"))
    return emitted.join(newest, [*keys, "version"]).drop("version")


def read_histories(spark: SparkSession, path: str, keys, order) -> DataFrame:
    """Current lists of a history table kept by :func:`history_table_stream`; ``recency`` is 1 for the newest."""
    rows = read_table(spark, path)
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])).cast("bigint"))


def history_table_stream(events: DataFrame, path: str, checkpoint: str, keys, order, n: int = HISTORY_CAP, bucket_bytes: int = BUCKET_BYTES):
    """Writer that keeps the newest ``n`` events of each key as a table, without Python state; start it with a trigger.

    Each micro-batch is capped inside every task first, so a hot key sends ``n`` rows per task, and only the lists
    of touched buckets of keys are read and rewritten.
    """
    def newest(rows: DataFrame) -> DataFrame:
        return capped_history(rows, keys, order, n).drop("recency")

    return table_stream(events, path, checkpoint, keys, newest, newest, bucket_bytes)
