"""Search terms in texts: all terms meet a text once, and a term is only tried where its rarest piece stands."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a piece, and terms that one pass over the texts looks for.
PIECE = 3
TERMS_AT_ONCE = 1 << 15
# Bytes of texts whose pieces are looked up together; a longer text is alone.
AT_ONCE_BYTES = 1 << 21

# Between the literal parts of a LIKE pattern: wildcards, and escapes with what they escape.
_GAPS = re.compile(rb"\\.?|[%_]", re.DOTALL)
# First number of the pieces of one, two and three bytes.
_BASE = (0, 0, 1 << 8, (1 << 8) + (1 << 16))


def wild(term) -> Column:
    """Whether a term holds a wildcard (or an escape)."""
    return F.contains(term, F.lit("%")) | F.contains(term, F.lit("_")) | F.contains(term, F.lit("\\"))


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width`` bytes."""
    code = data[: len(data) - width + 1].astype(np.int32)
    for i in range(1, width):
        code = (code << 8) | data[i:len(data) - width + 1 + i]
    return code + _BASE[width]


def pieces_of(term: bytes, literal: bool) -> np.ndarray:
    """Numbers of pieces that every match of a term holds; none for a pattern without literal parts.

    Parts of a pattern that are shorter than the longest piece are left out, so all pieces have one length.
    """
    parts = [p for p in ([term] if literal else _GAPS.split(term)) if p]
    width = min(PIECE, max(map(len, parts), default=0))
    found = [_codes(np.frombuffer(p, np.uint8), width) for p in parts if width and len(p) >= width]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


class Terms:
    """A set of lower-case terms and the pieces they are looked up by."""

    def __init__(self, terms: list[str], literal: bool):
        self.names = terms
        self.bytes = [t.encode() for t in terms]
        self.pattern = [not literal and any(c in t for c in "%_\\") for t in terms]
        own = [pieces_of(b, not p) for b, p in zip(self.bytes, self.pattern)]
        self.everywhere = [i for i, pieces in enumerate(own) if not len(pieces)]
        self.listed = np.array([i for i, pieces in enumerate(own) if len(pieces)], np.int64)
        flat = np.concatenate([own[i] for i in self.listed]) if len(self.listed) else np.zeros(0, np.int32)
        self.asked = np.unique(flat)
        self.piece = np.searchsorted(self.asked, flat)
        sizes = [len(own[i]) for i in self.listed]
        self.first = np.cumsum([0, *sizes])[:-1].astype(np.int64)
        self.table = np.zeros(_BASE[PIECE] + (1 << 8 * PIECE), bool)
        self.table[self.asked] = True
        self.widths = [w for w in range(1, PIECE + 1) if self.table[_BASE[w]:_BASE[w] + (1 << 8 * w)].any()]

    def candidates(self, texts: pa.Array):
        """Yield (term, rows) for every term that can stand in some of the texts; null texts hold nothing."""
        there = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        for term in self.everywhere:
            yield term, there
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        ends = offsets[1:] - offsets[0]
        ids, rows = [], []
        for width in self.widths:
            if len(data) < width:
                continue
            codes = _codes(data, width)
            places = np.flatnonzero(self.table[codes])
            row = np.searchsorted(ends, places, side="right")
            inside = places + width <= ends[row]
            ids.append(np.searchsorted(self.asked, codes[places[inside]]))
            rows.append(row[inside])
        if not ids:
            return
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        counts = np.bincount(ids, minlength=len(self.asked))
        order = np.argsort(ids, kind="stable")
        rows, begins = rows[order], np.cumsum(counts) - counts
        # The rarest piece of each term in these texts; a term with a piece that is not there is nowhere.
        rarest = np.minimum.reduceat((counts[self.piece] << 32) | self.piece, self.first)
        for term, piece in zip(self.listed[rarest >> 32 > 0], (rarest & 0xFFFFFFFF)[rarest >> 32 > 0]):
            own = rows[begins[piece]:begins[piece] + counts[piece]]
            yield int(term), own[np.append(True, own[1:] != own[:-1])]


def _in_parts(batches, columns):
    """Batches cut where their texts reach AT_ONCE_BYTES."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        begins = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE_BYTES, prepend=-1)).tolist()
        for begin, end in zip(begins, [*begins[1:], len(batch)]):
            yield batch.slice(begin, end - begin)


def _found(terms, kinds: dict[str, list[str]], keys: list[str]):
    """Arrow function: (key columns, kind, term, n, words, texts of a pattern's candidate) for all texts of a batch."""

    def run(batches):
        sets = {kind: Terms(own, literal) for kind, (own, literal) in terms.value.items()}
        for batch in _in_parts(batches, sorted({c for columns in kinds.values() for c in columns})):
            spots, kind_of, names, counts, words, shown = [], [], [], [], [], []
            for kind, columns in kinds.items():
                texts = [batch.column(c) for c in columns]
                own, size_of = sets[kind], {}
                hits: dict[tuple[int, int], int] = {}
                for k, column in enumerate(texts):
                    for term, rows in own.candidates(column):
                        wanted, pattern = own.bytes[term], own.pattern[term]
                        for row in rows.tolist():
                            n = column[row].as_buffer().to_pybytes().count(wanted) if wanted else 0
                            if n or pattern or not wanted:
                                hits[row, term] = hits.get((row, term), 0) + (n if k == 0 else 0)
                for (row, term), n in hits.items():
                    if row not in size_of:
                        size_of[row] = len((texts[0][row].as_py() or "").split())
                    spots.append(row)
                    kind_of.append(kind)
                    names.append(own.names[term])
                    counts.append(n)
                    words.append(size_of[row])
                    shown.append([t[row].as_py() for t in texts] if own.pattern[term] else None)
            taken = pa.array(spots, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(taken) for c in keys], pa.array(kind_of, pa.string()), pa.array(names, pa.string()),
                 pa.array(counts, pa.int64()), pa.array(words, pa.int64()), pa.array(shown, pa.list_(pa.string()))],
                [*keys, "kind", "term", "n", "words", "shown"])

    return run


def match_terms(rows: DataFrame, keys: list[str], kinds: dict[str, list[str]], terms: DataFrame, literal: bool = False) -> DataFrame:
    """Which terms stand in which texts: ``*keys, kind, term, n, words``, one row per row of ``rows``, kind and term found.

    ``kinds`` names the lower-case text columns that the terms of a kind are looked for in, ``terms`` has (kind, term), lower
    case. A term is found when any of the columns contains it, or fits it as a LIKE pattern where it has a wildcard
    and not ``literal``. ``n`` are its non-overlapping occurrences in the first column, ``words`` the words of that column.

    The texts are read where they lie, in one pass for up to ``TERMS_AT_ONCE`` different terms (the terms of requests, which
    are sent to the tasks) and one more for each further as many. In a batch of texts a term is tried only on those that hold
    its rarest piece of three bytes (shorter terms: themselves); patterns use their literal parts, and only a
    pattern without any is tried on every text.
    """
    asked = terms.where("term is not null").select("kind", "term").distinct()
    passes = max(1, -(-asked.count() // TERMS_AT_ONCE))
    texts = sorted({c for columns in kinds.values() for c in columns})
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    found = None
    for i in range(passes):
        own: dict[str, tuple[list[str], bool]] = {kind: ([], literal) for kind in kinds}
        for kind, term in asked.where(F.pmod(F.xxhash64("kind", "term"), F.lit(passes)) == i).collect():
            own[kind][0].append(term)
        sent = rows.sparkSession.sparkContext.broadcast(own)
        part = rows.select(*keys, *texts).mapInArrow(
            _found(sent, kinds, keys), f"{fields}, kind string, term string, n bigint, words bigint, shown array<string>")
        found = part if found is None else found.unionByName(part)
    pattern = F.concat(F.lit("%"), "term", F.lit("%"))
    fits = F.exists("shown", lambda text: F.coalesce(F.like(text, pattern), F.lit(False)))
    return found.where(F.col("shown").isNull() | fits).drop("shown")
