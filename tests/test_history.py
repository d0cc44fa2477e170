import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import history
from corpuscope.operators.history import (capped_history, delete_keys, followup_context, last_context, list_keys, live_history, live_sessions, merge_state,
                                          replace_history, running_context, session_status, sessions)
from corpuscope.operators.status import derive_status, status_counts
from corpuscope.streaming.history import capped_history_stream, history_table_stream, latest_history, read_histories
from corpuscope.streaming.history import ExpiringHistory, current_history, live_history_stream
from corpuscope.streaming.sessions import read_sessions, session_stream, session_table_stream
from corpuscope.streaming.tables import Snapshots, _bucket, _split, delete_from_table, read_table, replace_in_table, update_table
from tests.conftest import plan, rows

START = dt.datetime(2024, 1, 1)


def events(n=400, seed=1):
    rng = random.Random(seed)
    # Key 0 holds most of the rows.
    return [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, START + dt.timedelta(seconds=rng.randint(0, 40_000)), f"m{i}") for i in range(n)]


def frame(spark, data=None):
    return spark.createDataFrame(data or events(), "k int, seq int, ts timestamp, m string")


def brute_sessions(data, gap):
    out = []
    for k in sorted({e[0] for e in data}):
        times = sorted(e[2] for e in data if e[0] == k)
        group = [times[0]]
        for t in times[1:]:
            if (t - group[-1]).total_seconds() > gap:
                out.append((k, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        out.append((k, group[0], group[-1], len(group)))
    return sorted(out)


@pytest.mark.parametrize("gap", [60, 300, 5000])
def test_sessions_match_brute_force(spark, gap):
    data = events() + [(9, 1000 + i, START + dt.timedelta(seconds=i * gap), "x") for i in range(3)] + [
        (8, 2000, START, "x"), (8, 2001, START + dt.timedelta(seconds=gap, microseconds=1), "x")]
    got = sessions(frame(spark, data), ["k"], "ts", gap)
    assert sorted((r.k, r.created_at, r.last_activity, r.events) for r in got.collect()) == brute_sessions(data, gap)
    numbered = got.where("k = 0").orderBy("created_at").collect()
    assert [r.session_no for r in numbered] == list(range(1, len(numbered) + 1))
    assert all((r.expires_at - r.last_activity).total_seconds() == gap for r in numbered)
    now = START + dt.timedelta(seconds=20_000)
    assert live_sessions(got, F.lit(now)).count() == sum(e + dt.timedelta(seconds=gap) > now for _, _, e, _ in brute_sessions(data, gap))


def test_history_cap(spark):
    got = capped_history(frame(spark), ["k"], ["seq"], 7)
    data = events()
    for k in range(6):
        newest = sorted((e[1] for e in data if e[0] == k), reverse=True)[:7]
        assert [r.seq for r in got.where(F.col("k") == k).orderBy("recency").collect()] == newest
    assert "WindowGroupLimit" in plan(got)
    assert rows(capped_history(frame(spark), ["k"], ["seq"], 7, hot_keys=True)) == rows(got)
    counts = {e: sum(x[0] == e for x in data) for e in range(6)}
    assert dict(rows(list_keys(frame(spark), ["k"], 7))) == {k: min(n, 7) for k, n in counts.items()}


def test_delete_and_replace(spark):
    store = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, m string")
    updates = spark.createDataFrame([(1, "z"), (4, "n")], "k int, m string")
    gone = spark.createDataFrame([(3,)], "k int")
    assert rows(delete_keys(store, gone, ["k"])) == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(replace_history(store, updates, ["k"], gone)) == [(1, "z"), (2, "c"), (4, "n")]


@pytest.mark.parametrize("block", [1000, 8])
@pytest.mark.parametrize("cap", [None, 1, 3])
def test_context_over_blocks(spark, monkeypatch, block, cap):
    """A conversation longer than any cap, and one with gaps between its positions and a NULL message."""
    monkeypatch.setattr(history, "BLOCK", block)
    long = [(1, t, f"c1t{t}") for t in range(65)]
    gaps = [(2, t, None if t == 20 else f"c2t{t}") for t in (0, 10, 20, 1500, 2700, 5000)] + [(None, 7, "alone")]
    turns = spark.createDataFrame(long + gaps, "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn): r.context for r in running_context(turns, ["conv_id"], history=cap).collect()}
    tasks = {(r.conv_id, r.turn): r.developer_task for r in followup_context(turns, ["conv_id"], history=cap).collect()}
    assert len(got) == len(tasks) == len(long + gaps)
    for (c, t), text in got.items():
        own = [x for x in long + gaps if x[0] == c]
        at = [x[1] for x in own].index(t)
        earlier = [x[2] for x in own[:at]][-cap if cap else 0:]
        earlier = [m for m in earlier if m is not None]
        assert text == "\n".join([*earlier, *([own[at][2]] if own[at][2] is not None else [])])
        assert tasks[c, t].startswith(", ".join(earlier) + "\n\n --- the above") and f"requirements: {own[at][2] or ''}\n" in tasks[c, t]
    whole = {r.conv_id: (r.messages, r.context) for r in last_context(turns, ["conv_id"]).collect()}
    assert whole[1] == (65, "\n".join(x[2] for x in long)) and whole[2][0] == 5 and whole[None] == (1, "alone")


def test_state_merge_and_status(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "b", None), (2, 1, None, None)], "k int, seq int, status string, current_stage string")
    merged = merge_state(df, ["k"], "seq", ["status", "current_stage"])
    assert rows(merged) == [(1, "b", "x", 3), (2, None, None, 1)]
    status = session_status(merged.withColumnRenamed("last_update", "last_activity"), frame(spark), ["k"])
    assert {r.k: r.query_count for r in status.collect()} == {k: sum(e[0] == k for e in events()) for k in (1, 2)}


def test_status_rules(spark):
    names = ["communication_success", "enhancement_success", "is_satisfied", "master_planner_success", "master_planner_approved", "delta_analyzer_success",
             "code_validator_success", "has_validator_result", "has_validation_summary"]
    data = [
        ("a", True, True, True, True, None, False, False, False, False), ("b", True, True, True, True, False, False, False, False, False),
        ("c", True, True, False, False, None, False, False, False, False), ("d", False, False, False, False, None, False, False, False, False),
        ("e", True, False, False, False, None, False, False, False, False), ("f", True, True, True, True, True, True, False, True, True),
        ("g", True, True, True, True, True, True, True, True, True), ("h", True, True, True, True, True, True, True, True, False),
        ("i", True, True, True, True, True, True, False, False, False), ("j", True, True, True, True, True, False, False, None, None),
        ("k", True, True, True, False, None, False, False, None, None),
    ]
    schema = "id string, " + ", ".join(f"{n} boolean" for n in names)
    df = spark.createDataFrame(data, schema).withColumn("suggestions", F.array(F.lit("s")))
    got = {r.id: r.workflow_stage for r in derive_status(df).collect()}
    assert got == {"a": "master_planner_approval", "b": "restarting_after_rejection", "c": "query_refinement", "d": "communication_failed",
                   "e": "enhancement_failed", "f": "validation_feedback", "g": "completed", "h": "validation_summary_error",
                   "i": "code_generation", "j": "delta_analysis", "k": "master_planning"}
    assert sum(r.sessions for r in status_counts(df).collect()) == len(data)


@pytest.fixture
def event_files(spark, tmp_path):
    """Events in time order, in several files, so a stream takes several batches."""
    data = sorted(events(), key=lambda e: e[2])
    data = [(k, i, t, m) for i, (k, _, t, m) in enumerate(data)]
    for n in range(4):
        frame(spark, data[n * 100:(n + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, seq int, ts timestamp, m string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return data, stream, tmp_path


def test_history_stream_equals_batch(spark, event_files):
    data, stream, tmp = event_files
    capped_history_stream(stream, "k", "seq", "m", 6).writeStream.format("parquet").option("path", str(tmp / "out")).option(
        "checkpointLocation", str(tmp / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = latest_history(spark.read.parquet(str(tmp / "out")))
    want = capped_history(frame(spark, data), ["k"], ["seq"], 6)
    assert rows(got.select(F.col("key").cast("int"), "recency", "seq")) == rows(want.select("k", "recency", "seq"))


def test_history_table_equals_batch(spark, event_files):
    data, stream, tmp = event_files
    path = str(tmp / "table")
    history_table_stream(stream.drop("ts"), path, str(tmp / "ck2"), ["k"], ["seq"], 6, bucket_bytes=2000).trigger(availableNow=True).start().awaitTermination()
    got = read_histories(spark, path, ["k"], ["seq"])
    want = capped_history(frame(spark, data), ["k"], ["seq"], 6)
    assert rows(got.select("k", "recency", "seq", "m")) == rows(want.select("k", "recency", "seq", "m"))


def test_session_table_equals_batch(spark, event_files):
    """Open and closed sessions, whatever the order of the files; a batch that runs twice changes nothing."""
    data, stream, tmp = event_files
    path, gap = str(tmp / "sessions"), 300
    writer = session_table_stream(stream, path, str(tmp / "ck4"), ["k"], "ts", gap, bucket_bytes=2000)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    want = sessions(frame(spark, data), ["k"], "ts", gap)
    assert rows(read_sessions(spark, path, ["k"], gap)) == rows(want)
    # The same batches from the beginning: every bucket has seen them.
    again = session_table_stream(stream, path, str(tmp / "ck5"), ["k"], "ts", gap, bucket_bytes=2000)
    again.trigger(availableNow=True).start().awaitTermination()
    assert rows(read_sessions(spark, path, ["k"], gap)) == rows(want)


def test_session_stream_equals_closed_batch_sessions(spark, event_files):
    data, stream, tmp = event_files
    gap = 300
    session_stream(stream, ["k"], "ts", gap, "10 hours").writeStream.format("parquet").option("path", str(tmp / "s")).option(
        "checkpointLocation", str(tmp / "ck3")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp / "s"))
    mark = max(e[2] for e in data) - dt.timedelta(hours=10)
    want = sessions(frame(spark, data), ["k"], "ts", gap).where(F.col("expires_at") <= F.lit(mark))
    assert rows(got.select("k", "created_at", "last_activity", "events")) == rows(want.select("k", "created_at", "last_activity", "events"))
    assert want.count() > 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_live_history_stream_forgets_idle_keys(spark, event_files):
    """Lists that have run out by the watermark leave state and result; the others are those of the batch operator."""
    data, stream, tmp = event_files
    gap, late = 900, 60
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKS)
    try:
        query = live_history_stream(stream, "k", "seq", "ts", "m", 6, gap, f"{late} seconds").writeStream.format("parquet").option(
            "path", str(tmp / "live")).option("checkpointLocation", str(tmp / "ck6")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set(store, before)
    changes = spark.read.parquet(str(tmp / "live"))
    now = max(e[2] for e in data) - dt.timedelta(seconds=late)
    want = live_history(frame(spark, data), ["k"], ["seq"], "ts", 6, gap, F.lit(now))
    got = current_history(changes)
    assert rows(got.select(F.col("key").cast("int"), "recency", "seq", "message")) == rows(want.select("k", "recency", "seq", "m"))
    live = {r.key for r in got.collect()}
    assert live and live < {r.key for r in changes.collect()} and held < len({e[0] for e in data}) * 3
    assert changes.where("change = 'drop'").count() > 0


def kept(spark, path, data, **how):
    df = spark.createDataFrame(data, "k int, v int")
    return update_table(spark, path, ["k"], df, lambda stored: df if stored is None else stored.unionByName(df), **how)


def test_snapshots(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    assert kept(spark, path, [(i % 40, i) for i in range(400)] + [(None, 7)], through=0)
    assert not kept(spark, path, [(1, 1)], through=0)
    begun = read_table(spark, path)
    want = rows(begun)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            kept(spark, path, [(1, -1)], through=1)
    assert rows(read_table(spark, path)) == want and len(Snapshots(spark, path)._names("data")) == 2
    # The next writer commits, splits large buckets, and removes what the dead one left.
    assert kept(spark, path, [(k, -2) for k in range(40)], through=1, bucket_bytes=100)
    assert rows(read_table(spark, path)) == sorted(want + [(k, -2) for k in range(40)], key=repr) and rows(begun) == want
    table = Snapshots(spark, path)
    assert len(table._names("data")) == 2 and any(b.startswith("4-") for b in table.manifest()["buckets"])
    assert rows(read_table(spark, path, 1)) == want
    stale = table.manifest()
    kept(spark, path, [(3, 0)])
    with pytest.raises(RuntimeError):
        table.commit(stale | {"version": stale["version"] + 1})


def test_delete_and_replace_on_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i % 10, i) for i in range(100)] + [(None, 5)]
    kept(spark, path, data)
    gone = spark.createDataFrame([(1,), (None,), (77,)], "k int")
    delete_from_table(spark, path, gone, ["k"])
    left = [r for r in data if r[0] not in (1, None)]
    assert rows(read_table(spark, path)) == sorted(left, key=repr)
    replace_in_table(spark, path, spark.createDataFrame([(2, -1), (50, -1)], "k int, v int"), ["k"], spark.createDataFrame([(3,)], "k int"))
    left = [r for r in left if r[0] not in (2, 3)] + [(2, -1), (50, -1)]
    assert rows(read_table(spark, path)) == sorted(left, key=repr)


def test_many_buckets_split_at_once(spark, tmp_path):
    """The bucket of a key stays one short expression, however many buckets are split."""
    shallow = {f"{d}-{n}" for d, n in [(3, k) for k in range(8)] + [(4, 1), (5, 2)]}
    many = {f"9-{n}" for n in range(512)}
    few, all_ = (len(_bucket([F.col("k")], _split(names, names))._jc.toString()) for names in ({"9-0"}, many))
    assert all_ < few + 16 * len(many)
    # Halves: every key of a split bucket goes one bit deeper, all others stay where they were.
    keys = spark.range(2000).select(F.col("id").alias("k"))
    placed = keys.select(_bucket(["k"], shallow).alias("old"), _bucket(["k"], _split(shallow, {"3-1", "4-1", "3-5"})).alias("new"), F.xxhash64("k").alias("h"))
    for r in placed.collect():
        depth = int(r.old.split("-")[0]) + (r.old in {"3-1", "4-1", "3-5"})
        assert r.new == f"{depth}-{r.h % (1 << depth)}"
    path, data = str(tmp_path / "many"), [(i, i) for i in range(3000)]
    for step in range(4):
        kept(spark, path, data if step == 0 else [(i, -step) for i in range(3000)], bucket_bytes=1)
    assert read_table(spark, path).count() == 12000 and len(Snapshots(spark, path).manifest()["buckets"]) == 64
    assert rows(read_table(spark, path).where("v >= 0")) == sorted(data, key=repr)


def test_expiring_history_asks_its_state_little():
    """Calls to the state cost more than the work on a list: one read, and the timer is only moved when the newest message changes."""
    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.calls.append(("register", at))

        def deleteTimer(self, at):
            self.calls.append(("delete", at))

        def clear(self):
            self.value = None

        def getCurrentWatermarkInMs(self):
            return 0

    def batch(*times):
        return [pd.DataFrame({"ts_ms": times, "seq": times, "message": [str(t) for t in times]})]

    handle, history_ = Handle(), ExpiringHistory(3, 100)
    history_.init(handle)
    changes = [list(history_.handleInputRows(("k",), batch(*times), handle))[0] for times in ((10, 20), (15,), (30, 40))]
    assert handle.calls == ["get", ("register", 120), "update", "get", "update", "get", ("delete", 120), ("register", 140), "update"]
    assert [list(zip(c["change"], c["seq"])) for c in changes] == [
        [("add", 10), ("add", 20)], [("add", 15)], [("drop", 10), ("drop", 15), ("add", 30), ("add", 40)]]
