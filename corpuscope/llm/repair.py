"""Repair the structure of conversations: cheapest edits by a Viterbi search whose survivors share a tree of back pointers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import col

MARKS = ".!?"
LEGAL = frozenset({"su", "ua", "au"})
# Places in `(s?(ua)+)?`: nothing yet, after s, after u, after a. A conversation may end at START and A.
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
# The one role that may be put at a place, and where it leads.
PUT = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
# Inserts that complete what stands at a place.
CLOSE = {START: 0, A: 0, U: 1, S: 2}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Costs(NamedTuple):
    """Whole numbers, ``insert`` above 0; a text that is kept though cut off adds ``cut``."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    cut: int = 5


class Node:
    """One edit; ``refs`` counts the edits and survivors that build on it."""

    __slots__ = ("parent", "letter", "role", "refs", "kids")

    def __init__(self, parent, letter, role):
        self.parent, self.letter, self.role, self.refs, self.kids = parent, letter, role, 0, []


class Survivor(NamedTuple):
    cost: int
    rank: int  # order of the complete edit strings among the survivors
    node: Node
    digest: object  # SHA-256 of the repaired rows so far


class Search:
    """Cheapest edits of one conversation, read row by row; among equals the string of initials that is ASCII-least.

    A survivor is the best way to one place of the grammar. Edits are a tree: a survivor that is given up frees its
    edits up to the one that another still builds on, and while the root has a single branch, that edit is certain and is
    handed out. Ties are settled between complete edit strings: survivors have met the same rows, so of two strings
    none begins the other, and their order is carried along as a rank rather than read again from the tree. A
    survivor is also given up when another can imitate whatever follows for less (``extra``), so one that only deletes
    does not hold the root for ever. What stays open is what the rows leave open: in ``uuuu...`` the first edit depends
    on how many follow, and one small node per row is held. Texts are never held; each survivor carries the digest of
    its repaired rows.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.survivors = {START: Survivor(0, 0, self.root, hashlib.sha256())}
        d, i = costs.delete, costs.insert
        # extra[q]: most that going on from p can cost above going on from q over the same rows, for each p.
        self.extra = {
            START: {START: 0, A: d, U: max(2 * d, i), S: max(d, 2 * i)},
            S: {START: 0, A: 0, U: d, S: 0},
            U: {START: d, A: d, U: 0, S: d + 2 * i},
            A: {START: 0, A: 0, U: max(d, i), S: 2 * i}}

    def _worth(self, costs: dict) -> dict:
        """Cost above which a way to a place cannot be part of a cheapest whole."""
        return {q: min(cost + extra[p] for p, cost in costs.items()) for q, extra in self.extra.items()}

    def _release(self, node: Node):
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent

    def _settled(self) -> Iterator[tuple[str, str | None]]:
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.letter, self.root.role

    def _replace(self, chosen: list):
        """New survivors from ``(place, cost, survivor, from, edits, row said)`` in the order of their edit strings."""
        old, self.survivors = self.survivors, {}
        for rank, (place, cost, before, begun, edits, text) in enumerate(chosen):
            node, digest = before.node, before.digest
            for letter, role in edits:
                child = Node(node, letter, role)
                node.kids.append(child)
                node.refs += 1
                node = child
                if letter != "D":
                    said = f"{role}:{'' if letter == 'I' else text}"
                    digest = digest.copy()
                    digest.update(("\n" + said if begun else said).encode("utf-8", "surrogatepass"))
                    begun = True
            node.refs += 1
            self.survivors[place] = Survivor(cost, rank, node, digest)
        for survivor in old.values():
            self._release(survivor.node)

    def row(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str | None]]:
        """Read one row; edits that have become certain, as (initial, role or None)."""
        costs, initial = self.costs, role[:1]
        cut = costs.cut if fault == TRUNCATED else 0
        worth = self._worth({p: s.cost for p, s in self.survivors.items()})
        best: dict = {}

        def offer(place, cost, letters, before, begun, edits):
            key = (cost, before.rank, letters)
            if place not in best or key < best[place][0]:
                best[place] = (key, before, begun, edits)

        for first, before in self.survivors.items():
            place, cost, put = first, before.cost, []
            for _ in range(3):
                letters = "I" * len(put)
                offer(place, cost + costs.delete, letters + "D", before, first != START, [*put, ("D", None)])
                if fault not in (BLANK, DUPLICATE):
                    to = STEP.get((place, initial))
                    if to is not None:
                        offer(to, cost + cut, letters + "K", before, first != START, [*put, ("K", role)])
                    offer(PUT[place][1], cost + cut + costs.rerole, letters + "R", before, first != START,
                          [*put, ("R", PUT[place][0])])
                cost += costs.insert
                put = [*put, ("I", PUT[place][0])]
                place = PUT[place][1]
                if cost > worth[place]:
                    break
        worth = self._worth({p: key[0] for p, (key, *_) in best.items()})
        kept = sorted((key[1:], p) for p, (key, *_) in best.items() if key[0] <= worth[p])
        self._replace([(p, best[p][0][0], *best[p][1:], text) for _, p in kept])
        return self._settled()

    def end(self) -> Iterator[tuple[str, str | None]]:
        """The remaining edits; afterwards ``cost`` and ``sha256`` are those of the whole."""
        ends = []
        for place, s in self.survivors.items():
            edits, at = [], place
            for _ in range(CLOSE[place]):
                edits.append(("I", PUT[at][0]))
                at = PUT[at][1]
            ends.append((s.cost + self.costs.insert * len(edits), s.rank, place, edits))
        self.cost, _, place, edits = min(ends)
        self._replace([(place, self.cost, self.survivors[place], place != START, edits, "")])
        self.sha256 = self.survivors[place].digest.hexdigest()
        return self._settled()


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Conversations with planted faults: ``conv_id, turn, role, text, dropped``.

    The CRC-32 of ``id:turn`` modulo 20 decides (nulls count as one space): 0 drops the row (it stays, marked), 1 empties
    the text, 2 takes away its marks, 3 repeats the row, 4 gives it the role user.
    """
    def known(name):
        return F.coalesce(col(name).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(known(id_col), F.lit(":"), known(turn_col)).cast("binary")), F.lit(20))
    rows = conversations.select(
        col(id_col).alias("conv_id"), col(turn_col).alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"),
        fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("fault") == 0).alias("dropped"), twice.alias("time")).drop("time")


def ordered_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """``conv, turn, role, text, dropped, fault``: conversations side by side in their partition, each in its order.

    Rows go by turn, nulls first, then by role and text. Null roles and texts are one space. ``fault`` is the first of
    blank, duplicate (same role and text in an earlier row of the conversation) and truncated, or 0. Dropped rows have
    none and count nowhere. One exchange, by conversation, serves the search for duplicates and the order.
    """
    known = rows.select(
        col(id_col).alias("conv"), col(turn_col).cast("bigint").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col), F.lit(" ")).alias("text"),
        (F.coalesce(col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)).alias("dropped"))
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    known = known.withColumn("last", F.substring(end, -1, 1)).repartition("conv")
    before = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = (F.when(F.col("dropped"), 0).when(F.col("last") == "", BLANK).when(F.row_number().over(before) > 1, DUPLICATE)
             .when(F.col("last").isin(*MARKS), 0).otherwise(TRUNCATED))
    return known.select("conv", "turn", "role", "text", "dropped", fault.alias("fault")).sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)


def _conversations(batches):
    """The rows of sorted batches, with True in front where a conversation begins."""
    last, begun = None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "dropped", "fault")]
        for conv, *rest in zip(*columns):
            first = not begun or conv != last
            last, begun = conv, True
            yield first, conv, *rest


def repair_conversations(rows: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation, one row per id (null ids are one conversation).

    Returns ``<id_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: turns missing
    between the first and the last one, rows by their first fault (see :func:`ordered_rows`), neighbouring rows
    whose roles' initials are not su, ua or au, the least cost of edits that give initials ``(s?(ua)+)?``, their
    initials (Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant row; ASCII-least among the
    cheapest), and the SHA-256 of the repaired ``role:text`` lines. Blank and duplicate rows have to be deleted.
    A conversation whose rows are all dropped has zeros, an empty audit and the digest of the empty text. An empty table
    gives an empty result; other columns are not looked at.

    A conversation is a sequence, and its digest one chain: it is streamed through one task in its order, which Spark
    sorts (and spills) before. No conversation is ever held; a long one takes time, not memory, see :class:`Search`.
    """
    sorted_rows = ordered_rows(rows, id_col, turn_col, role_col, text_col, dropped_col)
    key = sorted_rows.schema["conv"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = f"conv {key}, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string"

    def run(batches):
        key_type = None
        done: list[tuple] = []

        def tables():
            columns = list(zip(*done)) if done else [()] * 9
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]],
                 *[pa.array(c, pa.string()) for c in columns[7:]]], ["conv", *names, "audit", "repaired_sha256"])

        def seen(source):
            nonlocal key_type
            for batch in source:
                key_type = batch.schema.field("conv").type
                yield batch

        state = None

        def finish():
            conv, search, audit, counts, illegal, _, turns = state
            audit += "".join(letter for letter, _ in search.end()).encode()
            low, high, distinct = turns
            gaps = 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)
            done.append((conv, gaps, *counts[1:], illegal, search.cost, audit.decode(), search.sha256))

        for first, conv, turn, role, text, dropped, fault in _conversations(seen(batches)):
            if first:
                if state:
                    finish()
                    if len(done) >= 4096:
                        yield tables()
                state = [conv, Search(costs), bytearray(), [0, 0, 0, 0], 0, None, (None, None, 0)]
            if dropped:
                continue
            _, search, audit, counts, _, before, (low, high, distinct) = state
            audit += "".join(letter for letter, _ in search.row(role, text, fault)).encode()
            counts[fault] += 1
            state[4] += before is not None and before + role[:1] not in LEGAL
            state[5] = role[:1]
            if turn is not None:
                state[6] = (turn if low is None else low, turn, distinct + (turn != high))
        if state:
            finish()
            yield tables()

    found = sorted_rows.mapInArrow(run, kind)
    return found.withColumnRenamed("conv", id_col)


def conversation_edits(rows: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits themselves, in order: ``<id_col>, step, row, edit, role``.

    ``step`` counts the edits of a conversation and ``row`` its rows in the order of :func:`ordered_rows`, from 1 on (null
    for inserted rows); ``role`` is the role afterwards, null for deleted rows. Edits leave a task as soon as they are
    certain. :func:`repaired_rows` puts them to the texts.
    """
    sorted_rows = ordered_rows(rows, id_col, turn_col, role_col, text_col)
    key = sorted_rows.schema["conv"].dataType.simpleString()

    def run(batches):
        key_type = None
        out: list[tuple] = []

        def table():
            columns = list(zip(*out)) if out else [()] * 5
            out.clear()
            kinds = [key_type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["conv", "step", "row", "edit", "role"])

        def seen(source):
            nonlocal key_type
            for batch in source:
                key_type = batch.schema.field("conv").type
                yield batch

        search = name = None
        step = row = 0

        def note(edits):
            nonlocal step, row
            for letter, role in edits:
                step += 1
                row += letter != "I"
                out.append((name, step, None if letter == "I" else row, letter, role))

        for first, conv, _, role, text, _, fault in _conversations(seen(batches)):
            if first:
                if search:
                    note(search.end())
                search, name, step, row = Search(costs), conv, 0, 0
            note(search.row(role, text, fault))
            if len(out) >= 4096:
                yield table()
        if search:
            note(search.end())
            yield table()

    return sorted_rows.mapInArrow(run, f"conv {key}, step bigint, row bigint, edit string, role string").withColumnRenamed("conv", id_col)


def repaired_rows(rows: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``<id_col>, step, role, text`` without deleted rows, inserted ones with empty text."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = ordered_rows(rows, id_col, turn_col, role_col, text_col).select(
        "conv", F.row_number().over(order).cast("bigint").alias("n"), "text")
    edits = conversation_edits(rows, costs, id_col, turn_col, role_col, text_col).where("edit <> 'D'")
    joined = edits.join(numbered, col(id_col).eqNullSafe(F.col("conv")) & (F.col("row") == F.col("n")), "left")
    return joined.select(col(id_col), "step", "role", F.coalesce("text", F.lit("")).alias("text"))
