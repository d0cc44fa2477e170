import os
import random

import pytest

from corpuscope.operators import contexts
from corpuscope.operators.contexts import context_blocks, contexts_at, read_blocks, store_contexts
from corpuscope.operators.history import running_context
from tests.conftest import rows

SCHEMA = "conv int, turn int, text string"


def conversations():
    rng = random.Random(4)
    found = [(1, t, f"m{t} " + "x" * rng.randint(0, 5)) for t in range(150)]
    found += [(2, t, None if t == 20 else f"n{t}") for t in (0, 10, 20, 1500, 2700, 5000)] + [(None, 7, "alone"), (3, 1, None), (4, None, "first"), (4, 2, "")]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("width", [1, 7, 64])
def test_contexts_of_all_turns(spark, monkeypatch, width):
    monkeypatch.setattr(contexts, "WIDTH", width)
    turns = spark.createDataFrame(conversations(), SCHEMA)
    got = contexts_at(turns, context_blocks(turns, ["conv"]), ["conv"])
    want = {(r.conv, r.turn): r.context for r in running_context(turns, ["conv"]).collect()}
    assert {(r.conv, r.turn): r.context for r in got.collect()} == want | {(3, 1): None}
    before = {(r.conv, r.turn): r.context for r in contexts_at(turns, context_blocks(turns, ["conv"]), ["conv"], separator=", ", own=False).collect()}
    own = sorted(t for c, t, _ in conversations() if c == 1)
    text = {t: m for c, t, m in conversations() if c == 1}
    assert all(before[1, t] == (", ".join(text[k] for k in own[:i]) or None) for i, t in enumerate(own)) and before[None, 7] is None


def test_appends_repeats_and_asked_turns(spark, tmp_path):
    path = str(tmp_path / "blocks")
    turns = spark.createDataFrame(conversations(), SCHEMA)
    assert read_blocks(spark, path) is None
    early = "coalesce(turn, 0) < 70"
    for part in (early, early, f"not {early}", f"not {early}", "false"):
        store_contexts(turns.where(part), path, ["conv"])
    blocks = read_blocks(spark, path)
    stored = [(r.conv, p, m) for r in blocks.collect() for p, m in zip(r.positions, r.messages)]
    assert sorted(stored, key=repr) == sorted(conversations(), key=repr)
    asked = spark.createDataFrame([(1, 149), (1, 0), (1, 149), (2, 2700), (2, 3), (9, 1), (None, 7)], "conv int, turn int")
    want = {(r.conv, r.turn): r.context for r in running_context(turns, ["conv"]).collect()}
    assert rows(contexts_at(asked, blocks, ["conv"])) == sorted(
        [(*k, want[k]) for k in [(1, 149), (1, 0), (2, 2700), (None, 7)]], key=repr)
    assert contexts_at(asked.limit(0), blocks, ["conv"]).count() == 0


def test_repeated_turns_and_other_columns(spark):
    turns = spark.createDataFrame([(1, 1, "b", 9), (1, 1, "a", 8), (1, 2, "c", 7)], SCHEMA + ", block int")
    got = contexts_at(turns, context_blocks(turns, ["conv"]), ["conv"])
    assert rows(got) == [(1, 1, "a\nb"), (1, 2, "a\nb\nc")]


def test_stored_size_is_linear(spark, tmp_path):
    def size(n):
        path = str(tmp_path / str(n))
        # Texts that do not compress, so that bytes count messages.
        store_contexts(spark.range(n).selectExpr("1 as conv", "id as turn", "sha2(cast(id as string), 256) as text").coalesce(1), path, ["conv"])
        return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))

    assert size(20000) < 2.3 * size(10000)
