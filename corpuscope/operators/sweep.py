"""Long lists of edits of one text, made in few passes over it instead of one pass and one copy for each edit."""

from __future__ import annotations

from bisect import bisect_left
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from corpuscope.operators.matching import Terms

# Characters of a part of the text that places are looked up in, and of the longest old text that is looked up so.
PART = 1 << 14
LONGEST = 1 << 12
# Edits that one pass tries at most, near neighbours an edit may have in it, edits below which a pass is not worth it, plain
# steps after such a pass.
AT_ONCE = 1 << 14
NEAR = 8
FEW = 16
PLAIN = 256

OUTCOME = "text string, ok boolean, applied int, skipped int"


def add_lines(text: str, adds: list[tuple[int, str]]) -> str:
    """Additions in their order, each line number at most the one before; beyond the end, or without a number, at the end."""
    lines = text.split("\n")
    at: dict[int, list[str]] = {}
    for line, new in adds:
        if 1 <= line <= len(lines):
            at.setdefault(line, []).append(new)
        else:
            lines.extend(new.split("\n"))
    # The last addition before a line stands first.
    return "\n".join(part for n, own in enumerate(lines, 1) for part in (*reversed(at.get(n, ())), own))


class Places:
    """Occurrences of many old texts in a text, found by their rarest pieces in its parts."""

    def __init__(self, text: str, olds: list[str], longest: int):
        self.text, self.reach = text, PART + longest - 1
        parts = [text[s:s + self.reach] for s in range(0, len(text), PART)]
        self.parts = {olds[term]: rows for term, rows in Terms(olds, True).candidates(pa.array(parts, pa.large_string()))}
        self.next = dict.fromkeys(olds, (0, 0))

    def following(self, old: str) -> int:
        """Where the next occurrence begins, overlapping ones included; -1 when there is none."""
        i, start = self.next[old]
        parts = self.parts.get(old, ())
        while i < len(parts):
            first = int(parts[i]) * PART
            at = self.text.find(old, max(start, first), first + self.reach)
            if at >= 0:
                self.next[old] = (i, at + 1)
                return at
            i += 1
        self.next[old] = (i, start)
        return -1


def independent(text: str, swaps: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """A beginning of the swaps, found by one pass, that can be made at once: (place, old, new) of each.

    Each takes the first occurrence in the text as it stands that no earlier swap touches. What earlier swaps have made of the
    text around them is kept with them, a swap and its near neighbours as one; the beginning ends before a swap whose old text
    such a new stretch holds further left, or has ``NEAR`` neighbours.
    """
    short = next((n for n, (old, _) in enumerate(swaps) if len(old) > LONGEST), len(swaps))
    olds = list(dict.fromkeys(old for old, _ in swaps[:short]))
    if not olds:
        return []
    longest = max(map(len, olds))
    places, begins, zones, made, around, pure = Places(text, olds, longest), [], [], [], [], []
    for old, new in swaps[:short]:
        at = places.following(old)
        i = bisect_left(begins, at)
        while at >= 0 and ((i and zones[i - 1][1] > at) or (i < len(begins) and at + len(old) > begins[i])):
            at = places.following(old)
            i = bisect_left(begins, at)
        if at < 0:
            break
        begins.insert(i, at)
        zones.insert(i, (at, at + len(old), new))
        low = high = i
        while low and zones[low][0] - zones[low - 1][1] < longest and high - low < NEAR:
            low -= 1
        while high + 1 < len(zones) and zones[high + 1][0] - zones[high][1] < longest and high - low < NEAR:
            high += 1
        if high - low == NEAR:
            break
        made.append((at, old, new))
        near = zones[low:high + 1]
        stretch = text[max(0, near[0][0] - longest + 1):near[0][0]] + "".join(
            own + text[end:begin] for (_, end, own), (begin, _, _) in zip(near, near[1:])) + near[-1][2]
        # Nothing that begins behind the last new text is of the swaps' making.
        pure.append(len(stretch))
        around.append((near[0][0], stretch + text[near[-1][1]:near[-1][1] + longest - 1]))
    uses: dict[str, list[int]] = {}
    for n, (_, old, _) in enumerate(made):
        uses.setdefault(old, []).append(n)
    cut = len(made)
    for term, rows in Terms(olds, True).candidates(pa.array([t for _, t in around], pa.large_string())) if made else ():
        old = olds[term]
        again = [n for n in rows.tolist() if 0 <= around[n][1].find(old) < pure[n]]
        first, k = len(text), 0
        for n in uses.get(old, ()):
            while k < len(again) and again[k] < n:
                first, k = min(first, around[again[k]][0]), k + 1
            if first < made[n][0]:
                cut = min(cut, n)
                break
    return made[:cut]


def swap_texts(text: str, swaps: list[tuple[str, str]]) -> str | None:
    """Each swap changes the first occurrence in what the one before has left; None when one finds nothing."""
    done = 0
    while done < len(swaps):
        if len(swaps) - done >= FEW:
            made = independent(text, swaps[done:done + AT_ONCE])
            parts, end = [], 0
            for at, old, new in sorted(made):
                parts += (text[end:at], new)
                end = at + len(old)
            text = "".join([*parts, text[end:]])
            done += len(made)
            if len(made) >= FEW:
                continue
        for old, new in swaps[done:done + PLAIN]:
            at = text.find(old)
            if at < 0:
                return None
            text = text[:at] + new + text[at + len(old):]
        done += PLAIN
    return text


def edit_text(text: str, edits: list[dict]) -> dict:
    """Outcome of edits (action, line_number, old, new) in their order, as :func:`corpuscope.operators.edits.apply_edits` makes them."""
    usable = [e for e in edits if e["action"] == "add" or e["old"] and (e["action"] == "delete" or e["action"] == "modify" and e["new"])]
    for adding, run in groupby(usable, lambda e: e["action"] == "add"):
        if adding:
            text = add_lines(text, [(e["line_number"], e["new"]) for e in run])
        else:
            text = swap_texts(text, [(e["old"], e["new"] if e["action"] == "modify" else "") for e in run])
        if text is None:
            return {"text": None, "ok": False, "applied": 0, "skipped": 0}
    return {"text": text, "ok": True, "applied": len(usable), "skipped": len(edits) - len(usable)}


@cache
def edited():
    """Column function of a text and its sorted edits; nothing for a missing text or list."""
    kind = pa.struct([("text", pa.string()), ("ok", pa.bool_()), ("applied", pa.int32()), ("skipped", pa.int32())])

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        # Most batches hold no long list.
        if lists.null_count == len(lists):
            return pa.nulls(len(lists), kind)
        rows = zip(texts, lists)
        return pa.array([edit_text(t.as_py(), e.as_py()) if t.is_valid and e.is_valid else None for t, e in rows], kind)

    return F.arrow_udf(run, OUTCOME)
