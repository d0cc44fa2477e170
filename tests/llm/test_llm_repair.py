import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

from corpuscope.llm.repair import Costs, Search, conversation_edits, damage, repair_conversations, repaired_rows

KIND = "conv_id bigint, turn bigint, role string, text string, conv string, fault int"
WHOLE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not shown else 2 if (role, text) in seen else 0 if shown[-1] in ".!?" else 3
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows, costs=Costs()):
    """Cheapest (cost, letters, repaired) over complete strings, without dropping any place or way."""
    ways = {"": (0, "", ())}  # what stands so far, cut to the shortest text with the same future

    def short(done):
        return done if len(done) < 2 else "ua" if done[-1] == "a" else "u"

    def offer(into, done, way):
        if done not in into or way < into[done]:
            into[done] = way

    def inserted(found):
        for _ in range(3):
            for done, (cost, letters, said) in list(found.items()):
                for role in ("user", "assistant"):
                    if re.fullmatch(r"s?(ua)*u?", done + role[0]):
                        offer(found, short(done + role[0]), (cost + costs.insert, letters + "I", (*said, f"{role}:")))
        return found

    for role, text, fault in rows:
        after = {}
        for done, (cost, letters, said) in inserted(dict(ways)).items():
            offer(after, done, (cost + costs.delete, letters + "D", said))
            if fault in (1, 2):
                continue
            more = costs.cut if fault == 3 else 0
            for letter, new, price in (("K", role, 0), ("R", "user", costs.rerole), ("R", "assistant", costs.rerole)):
                if new and re.fullmatch(r"s|s?(ua)*u?", done + new[0]) and (letter == "K" or new != role):
                    offer(after, short(done + new[0]), (cost + price + more, letters + letter, (*said, f"{new}:{text}")))
        ways = after
    ends = [way for done, way in inserted(dict(ways)).items() if WHOLE.fullmatch(done)]
    cost, letters, said = min(ends)
    return cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest()


def exhaustive(rows, costs):
    """All strings of edits with at most one insert at each place."""
    best = None
    gaps = [[(), ("user",), ("assistant",)]] * (len(rows) + 1)
    for puts in product(*gaps):
        for letters in product("KUAD", repeat=len(rows)):
            cost, audit, said = 0, "", []
            for k, put in enumerate(puts):
                audit, cost = audit + "I" * len(put), cost + costs.insert * len(put)
                said += [f"{r}:" for r in put]
                if k == len(rows):
                    break
                (role, text, fault), letter = rows[k], letters[k]
                if letter == "D":
                    cost, audit = cost + costs.delete, audit + "D"
                    continue
                new = {"K": role, "U": "user", "A": "assistant"}[letter]
                cost += (costs.cut if fault == 3 else 0) + (costs.rerole if letter != "K" else 0)
                cost += 10 ** 6 if fault in (1, 2) else 0
                audit += "K" if letter == "K" else "R"
                said.append(f"{new}:{text}")
            if WHOLE.fullmatch("".join(x[:1] or "-" for x in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return best


def run(rows, costs=Costs()):
    search, letters = Search(costs), ""
    for row in rows:
        letters += "".join(x for x, _ in search.row(*row))
    letters += "".join(x for x, _ in search.end())
    return search.cost, letters, search.sha256


ALL_COSTS = [Costs(), Costs(3, 4, 1, 2), Costs(0, 1, 1, 0), Costs(2, 9, 2, 1)]


@pytest.mark.parametrize("costs", ALL_COSTS)
def test_search_equals_plain_strings(costs):
    rng = random.Random(9)
    for roles in ("ua", "uuua", "sua", "suax", "u", "a"):
        for _ in range(150):
            rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[rng.choice(roles)], rng.choice(["a.", "b!", "c", "", "d?"]) + str(k) * rng.randrange(2) + ".",
                     rng.choice([0, 0, 0, 0, 1, 2, 3])) for k in range(rng.randrange(12))]
            assert run(rows, costs) == plain(rows, costs)


@pytest.mark.parametrize("costs", ALL_COSTS)
def test_plain_strings_equal_all_strings(costs):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 3, 3, 4):
        rows = [(rng.choice(["system", "user", "assistant", ""]), f"{k}.", rng.choice([0, 0, 0, 3, 1])) for k in range(n)]
        found = exhaustive(rows, costs)
        if costs.insert > 2 * costs.delete:  # else two inserts in a row can be cheapest
            assert plain(rows, costs) == found


def test_open_edits_stay_few():
    search, held = Search(), 0
    rng = random.Random(1)
    for k in range(30_000):
        role = "user" if rng.random() < 0.5 else "assistant"
        list(search.row(role, f"{k}.", rng.choice([0] * 9 + [1, 2, 3])))
        node, open_ = next(iter(search.survivors.values())).node, 0
        while node is not search.root:
            node, open_ = node.parent, open_ + 1
        held = max(held, open_)
    assert held < 200


def brute(rows):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        own = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x, *_ in own]
        found = faults([(r, x) for _, r, x in own])
        turns = [t for t, *_ in own if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(found, found[1:])]
        kinds = [f for *_, f in found]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, kinds.count(1), kinds.count(2), kinds.count(3), sum(p not in ("su", "ua", "au") for p in pairs), *plain(found)))
    return sorted(out, key=repr)


def sample(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \n", f"Turn {turn}!", f"Turn {turn}", None, "a.\n", "é? "])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text, "x", 1)] * rng.choice([1, 1, 1, 2])
    return rows


def test_conversations(spark):
    rows = sample(1, 60)
    got = repair_conversations(spark.createDataFrame(rows, KIND).repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_edits_and_repaired_rows(spark):
    df = spark.createDataFrame(sample(2, 40), KIND)
    facts = {r.conv_id: r for r in repair_conversations(df).collect()}
    edits = sorted(conversation_edits(df).collect(), key=lambda r: (repr(r.conv_id), r.step))
    said = sorted(repaired_rows(df).collect(), key=lambda r: (repr(r.conv_id), r.step))
    for conv, r in facts.items():
        assert "".join(e.edit for e in edits if e.conv_id == conv) == r.audit
        lines = "\n".join(f"{s.role}:{s.text}" for s in said if s.conv_id == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256


def test_damage(spark):
    rows = [(c if c else None, t, "assistant", "A. B!", "", 0) for c in range(30) for t in (None, *range(6))] + [(1, 1, None, None, "", 0)]
    got = damage(spark.createDataFrame(rows, KIND)).collect()
    want = []
    for c, t, role, text, *_ in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if f == 4 else role, "" if f == 1 else text.replace(".", "").replace("!", "") if f == 2 else text, f == 0)
        want += [row] * (2 if f == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_dropped_empty_and_long(spark):
    kind = "conv_id string, turn int, role string, text string, dropped boolean"
    rows = [("gone", 1, "user", "x", True), ("half", 1, "user", "x.", True), ("half", 2, "user", "x.", False), ("half", 3, "assistant", "y.", None)]
    got = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, kind), dropped_col="dropped").collect()}
    assert tuple(got["gone"])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got["half"].audit == "KK" and got["half"].duplicate == 0 and got["half"].gaps == 0
    assert repair_conversations(spark.createDataFrame([], KIND)).count() == 0
    hot = [(7, k, ("user", "assistant")[k % 2], f"{k} " + "long " * (4000 if k == 5 else 1) + ".", "", 0) for k in range(20_000)]
    one = repair_conversations(spark.createDataFrame(hot, KIND)).first()
    assert one.audit == "K" * 20_000 and one.cost == 0
    assert one.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x, *_ in hot).encode()).hexdigest()
