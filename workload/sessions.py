"""Registered history, session and status queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import contexts, history
from corpuscope.operators.status import derive_status, status_counts
from corpuscope.session import shared_dir
from corpuscope.streaming.history import (
    capped_history_stream,
    current_history,
    history_table_stream,
    latest_history,
    live_history_stream,
    read_histories,
)
from corpuscope.streaming.sessions import read_sessions, session_stream, session_table_stream
from corpuscope.streaming.tables import delete_from_table, replace_in_table
from workload.tables import CTES, sql, table

HALF_DAY = 12 * 3600


def events(spark, sf):
    return table(spark, sf, "events")


def recent_events(spark, sf):
    return history.capped_history(events(spark, sf), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "recency", "event_id", "event_type", "value")


RECENT_EVENTS = """
    SELECT user_id, recency, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events)
    WHERE recency <= 50
"""


def recent_events_stream(spark, sf):
    """The same list kept by a stream; the last emission of every key."""
    source = events(spark, sf)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = shared_dir(spark, "history")
    emitted = capped_history_stream(stream, "user_id", "event_id", "event_type")
    emitted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    latest = latest_history(spark.read.parquet(f"{out}/rows"))
    return latest.select(F.col("key").cast("bigint").alias("user_id"), "recency", F.col("seq").alias("event_id"),
                         F.col("message").alias("event_type"))


def event_files(spark, sf, out):
    """The events as a stream of four files, one per micro-batch, in no order of time."""
    source = events(spark, sf)
    source.repartition(4).write.parquet(f"{out}/source")
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/source")


def recent_events_table(spark, sf):
    """The same list kept as a table by micro-batches."""
    out = shared_dir(spark, "history")
    rows = event_files(spark, sf, out).select("user_id", "event_id", "event_type")
    history_table_stream(rows, f"{out}/table", f"{out}/state", ["user_id"], ["event_id"]).trigger(
        availableNow=True).start().awaitTermination()
    return read_histories(spark, f"{out}/table", ["user_id"], ["event_id"]).select("user_id", "recency", "event_id", "event_type")


RECENT_EVENTS_STREAM = """
    SELECT user_id, recency, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS recency FROM events)
    WHERE recency <= 50
"""


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiring_events_stream(spark, sf):
    """Lists of events that run out half a day after the last one, kept by a stream that forgets idle users."""
    out = shared_dir(spark, "expiring")
    source = events(spark, sf)
    source.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/source")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/source")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKS)
    try:
        # Files are read in any order, so no event may count as late.
        live_history_stream(stream, "user_id", "event_id", "ts", "event_type", 50, HALF_DAY, "10000 days").writeStream.format(
            "parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(
            availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return current_history(spark.read.parquet(f"{out}/rows")).select(
        F.col("key").cast("bigint").alias("user_id"), "recency", F.col("seq").alias("event_id"), F.col("message").alias("event_type"))


EXPIRING_EVENTS = f"""
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS recency, event_id, event_type
    FROM (SELECT *, max(opens) OVER (PARTITION BY user_id) AS opened FROM (
        SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) > {HALF_DAY * 1000}
                       THEN epoch_ms(ts) ELSE 0 END AS opens FROM events))
    WHERE epoch_ms(ts) >= opened QUALIFY recency <= 50
"""


def stored_changes(spark, sf):
    """A kept table of histories after users were deleted from it and others got another history."""
    out = shared_dir(spark, "stored")
    rows = event_files(spark, sf, out).select("user_id", "event_id", "event_type")
    history_table_stream(rows, f"{out}/table", f"{out}/state", ["user_id"], ["event_id"], bucket_bytes=1 << 14).trigger(
        availableNow=True).start().awaitTermination()
    source = events(spark, sf)
    delete_from_table(spark, f"{out}/table", source.where("user_id % 5 = 0"), ["user_id"])
    again = source.where("user_id % 5 = 1").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("event_type", F.lit("kept"))
    replace_in_table(spark, f"{out}/table", again, ["user_id"], source.where("user_id % 5 = 2"))
    return read_histories(spark, f"{out}/table", ["user_id"], ["event_id"]).select("user_id", "recency", "event_id", "event_type")


STORED_CHANGES = """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS recency, event_id, event_type FROM (
        SELECT user_id, event_id, event_type FROM events WHERE user_id % 5 > 2
        UNION ALL SELECT user_id, max(event_id), 'kept' FROM events WHERE user_id % 5 = 1 GROUP BY user_id)
    QUALIFY recency <= 50
"""


def as_ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


TIMES = ("created_at", "last_activity", "expires_at")


def half_day_sessions(spark, sf):
    return as_ntz(history.sessions(events(spark, sf), ["user_id"], gap_seconds=HALF_DAY), *TIMES)


def sessions_sql(gap):
    return f"""
    SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS created_at, max(ts) AS last_activity,
           max(ts) + INTERVAL {gap} SECOND AS expires_at, count(*) AS events
    FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {gap} SECOND
                               THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session_no"""


CTES["half_day"] = sessions_sql(HALF_DAY)
HALF_DAY_SESSIONS = sql("SELECT * FROM half_day")


def weekly_sessions(spark, sf):
    return as_ntz(history.sessions(events(spark, sf), ["user_id"]), *TIMES)


WEEKLY_SESSIONS = sessions_sql(604800)


def live_at_end(spark, sf):
    """Sessions still open half a day before the last event."""
    found = history.sessions(events(spark, sf), ["user_id"], gap_seconds=HALF_DAY)
    last = events(spark, sf).agg(F.max(F.col("ts").cast("timestamp")).alias("t"))
    return as_ntz(history.live_sessions(found, last.select(F.col("t") - F.expr("INTERVAL 6 HOUR")).scalar()), *TIMES)


LIVE_AT_END = sql("SELECT * FROM half_day WHERE expires_at > (SELECT max(ts) - INTERVAL 6 HOUR FROM events)")


def live_events(spark, sf):
    """Newest events of every user since the last pause of half a day."""
    kept = history.live_history(events(spark, sf), ["user_id"], ["ts", "event_id"], gap_seconds=HALF_DAY)
    return kept.select("user_id", "recency", "event_id")


LIVE_EVENTS = sql("""
    SELECT user_id, recency, event_id FROM (
        SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS recency, opened
        FROM events e JOIN (SELECT user_id, max(created_at) AS opened FROM half_day GROUP BY user_id) s ON s.user_id = e.user_id)
    WHERE recency <= 50 AND ts >= opened
""")


def closed_sessions_stream(spark, sf):
    """Sessions the stream has closed once all events are read."""
    source = events(spark, sf)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = shared_dir(spark, "sessions")
    session_stream(stream, ["user_id"], gap_seconds=HALF_DAY).writeStream.format("parquet").option(
        "path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    return as_ntz(spark.read.parquet(f"{out}/rows"), *TIMES)


def all_sessions_table(spark, sf):
    """All sessions, open ones too, kept as a table by micro-batches."""
    out = shared_dir(spark, "sessions")
    session_table_stream(event_files(spark, sf, out), f"{out}/table", f"{out}/state", ["user_id"], gap_seconds=HALF_DAY).trigger(
        availableNow=True).start().awaitTermination()
    return as_ntz(read_sessions(spark, f"{out}/table", ["user_id"], HALF_DAY), *TIMES)


CLOSED_SESSIONS_STREAM = sql("""
    SELECT user_id, created_at, last_activity, expires_at, events FROM half_day
    WHERE expires_at <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
""")


def user_keys(spark, sf):
    return history.list_keys(events(spark, sf), ["user_id"])


USER_KEYS = "SELECT user_id, least(count(*), 50) AS history_count FROM events GROUP BY user_id"


def after_delete(spark, sf):
    """Events without those of users that ever had an error worth over 49."""
    gone = events(spark, sf).where((F.col("event_type") == "error") & (F.col("value") > 49))
    return history.delete_keys(events(spark, sf), gone, ["user_id"]).select("event_id", "user_id")


AFTER_DELETE = """
    SELECT event_id, user_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 49)
"""


def replaced(spark, sf):
    """Purchases rewrite the history of their user; users with a large signup end without one."""
    store = events(spark, sf).select("user_id", "event_id", "event_type")
    updates = store.where(F.col("event_type") == "purchase").withColumn("event_type", F.lit("rewritten"))
    emptied = events(spark, sf).where((F.col("event_type") == "signup") & (F.col("value") > 60))
    return history.replace_history(store, updates, ["user_id"], emptied)


REPLACED = """
    WITH updates AS (SELECT user_id, event_id, 'rewritten' AS event_type FROM events WHERE event_type = 'purchase'),
    gone AS (SELECT user_id FROM updates UNION SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60)
    SELECT user_id, event_id, event_type FROM events WHERE user_id NOT IN (FROM gone)
    UNION ALL SELECT * FROM updates
"""


def conversation_context(spark, sf):
    turns = table(spark, sf, "conversations")
    return history.running_context(turns, ["conv_id"]).select("conv_id", "turn", "context")


CONVERSATION_CONTEXT = """
    SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context
    FROM conversations
"""


def stored_contexts(spark, sf):
    """The conversations stored in two appends, the second sent twice, and the contexts of every third turn and of each last one."""
    turns, path = table(spark, sf, "conversations"), shared_dir(spark, "contexts")
    for part in ("turn < 4", "turn >= 4", "turn >= 4"):
        contexts.store_contexts(turns.where(part), path, ["conv_id"])
    asked = turns.where("turn % 3 = 0").select("conv_id", "turn").unionByName(turns.groupBy("conv_id").agg(F.max("turn").alias("turn")))
    return contexts.contexts_at(asked, contexts.read_blocks(spark, path), ["conv_id"])


STORED_CONTEXTS = """
    SELECT conv_id, turn, context FROM (
        SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last,
               string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context
        FROM conversations)
    WHERE turn % 3 = 0 OR turn = last
"""


def whole_conversations(spark, sf):
    return history.last_context(table(spark, sf, "conversations"), ["conv_id"])


WHOLE_CONVERSATIONS = """
    SELECT conv_id, count(text) AS messages, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id
"""


def followup_tasks(spark, sf):
    turns = table(spark, sf, "conversations")
    return history.followup_context(turns, ["conv_id"]).select("conv_id", "turn", "developer_task")


FOLLOWUP_TASKS = """
    SELECT conv_id, turn,
           coalesce(string_agg(text, ', ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
           || chr(10) || chr(10) || ' --- the above are the previously used user_queries. ---' || chr(10)
           || ' Additional requirements: ' || text || chr(10) || chr(10) || ' Please create a new approach considering this feedback.' AS developer_task
    FROM conversations
"""


def state_updates(spark, sf):
    """Every event updates some fields of its user's state."""
    kind = F.col("event_type")
    return events(spark, sf).select(
        "user_id", "event_id", "ts",
        F.when(kind != "view", kind).alias("current_stage"),
        F.when(kind == "purchase", "completed").when(kind == "signup", "active").alias("status"),
        F.when(F.col("value") > 20, F.col("props")).alias("state"),
    )


FIELDS = ["current_stage", "status", "state"]


def merged_state(spark, sf):
    return history.merge_state(state_updates(spark, sf), ["user_id"], "event_id", FIELDS)


CTES["merged_state"] = """
    SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS current_stage,
           arg_max(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'active' END, event_id)
               FILTER (event_type IN ('purchase', 'signup')) AS status,
           arg_max(props, event_id) FILTER (value > 20) AS state, max(event_id) AS last_update
    FROM events GROUP BY user_id
"""
MERGED_STATE = sql("SELECT * FROM merged_state")


def session_lookup(spark, sf):
    state = merged_state(spark, sf).withColumnRenamed("last_update", "last_activity")
    kept = history.capped_history(events(spark, sf), ["user_id"], ["event_id"])
    return history.session_status(state, kept, ["user_id"])


SESSION_LOOKUP = sql("""
    SELECT m.user_id, status, last_update AS last_activity, current_stage, least(n, 50) AS query_count
    FROM merged_state m JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) c ON c.user_id = m.user_id
""")


def run_states(spark, sf):
    """State flags of a run per order."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key,
        (key % 11 != 0).alias("communication_success"),
        (key % 7 != 0).alias("enhancement_success"),
        (key % 5 != 0).alias("is_satisfied"),
        F.when(key % 3 != 0, F.array(F.lit("say more"))).alias("suggestions"),
        (F.col("o_orderstatus") != "P").alias("master_planner_success"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 4 != 1).alias("master_planner_approved"),
        (F.col("o_custkey") % 2 == 0).alias("delta_analyzer_success"),
        (F.col("o_orderpriority") != "1-URGENT").alias("code_validator_success"),
        (F.col("o_orderpriority") < "4").alias("has_validator_result"),
        (key % 13 != 0).alias("has_validation_summary"),
    )


def run_status(spark, sf):
    return derive_status(run_states(spark, sf)).select("o_orderkey", "status", "workflow_stage")


CTES["run_status"] = """
    SELECT o_orderkey, split_part(pair, '/', 1) AS status, split_part(pair, '/', 2) AS workflow_stage FROM (
        SELECT *, CASE
            WHEN o_orderstatus <> 'P' AND o_custkey % 4 = 0 THEN 'waiting_for_input/master_planner_approval'
            WHEN o_custkey % 4 = 1 THEN 'restarting/restarting_after_rejection'
            WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 'query_refinement_needed/query_refinement'
            WHEN o_orderkey % 11 = 0 THEN 'communication_failed/communication_failed'
            WHEN o_orderkey % 7 = 0 THEN 'enhancement_failed/enhancement_failed'
            WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 13 = 0 THEN 'error/validation_error'
            WHEN o_orderpriority = '1-URGENT' THEN 'validation_failed/validation_feedback'
            WHEN o_orderpriority < '4' AND o_orderkey % 13 = 0 THEN 'error/validation_summary_error'
            WHEN o_orderpriority < '4' THEN 'completed/completed'
            WHEN o_custkey % 2 = 0 THEN 'processing/code_generation'
            WHEN o_orderstatus <> 'P' THEN 'processing/delta_analysis'
            ELSE 'processing/master_planning' END AS pair
        FROM orders)
"""
RUN_STATUS = sql("SELECT * FROM run_status")


def run_status_counts(spark, sf):
    return status_counts(run_states(spark, sf))


RUN_STATUS_COUNTS = sql("SELECT status, workflow_stage, count(*) AS sessions FROM run_status GROUP BY ALL")

QUERIES = {
    "capped_history": (recent_events, RECENT_EVENTS),
    "live_history": (live_events, LIVE_EVENTS),
    "capped_history_stream": (recent_events_stream, RECENT_EVENTS_STREAM),
    "history_table_stream": (recent_events_table, RECENT_EVENTS_STREAM),
    "live_history_stream": (expiring_events_stream, EXPIRING_EVENTS),
    "stored_history_changes": (stored_changes, STORED_CHANGES),
    "sessions": (half_day_sessions, HALF_DAY_SESSIONS),
    "weekly_sessions": (weekly_sessions, WEEKLY_SESSIONS),
    "live_sessions": (live_at_end, LIVE_AT_END),
    "session_table_stream": (all_sessions_table, HALF_DAY_SESSIONS),
    "session_stream": (closed_sessions_stream, CLOSED_SESSIONS_STREAM),
    "list_keys": (user_keys, USER_KEYS),
    "delete_keys": (after_delete, AFTER_DELETE),
    "replace_history": (replaced, REPLACED),
    "running_context": (conversation_context, CONVERSATION_CONTEXT),
    "stored_contexts": (stored_contexts, STORED_CONTEXTS),
    "last_context": (whole_conversations, WHOLE_CONVERSATIONS),
    "followup_context": (followup_tasks, FOLLOWUP_TASKS),
    "merge_state": (merged_state, MERGED_STATE),
    "session_status": (session_lookup, SESSION_LOOKUP),
    "derive_status": (run_status, RUN_STATUS),
    "status_counts": (run_status_counts, RUN_STATUS_COUNTS),
}
