"""Words of whole texts as 64-bit hashes, computed for many documents at once on Arrow batches.

Every separator used here is one ASCII byte, so cutting the UTF-8 bytes gives the same words as cutting the
characters. Texts are handled in pieces of about ``PIECE`` bytes that end at a separator: memory for the per-byte
arrays does not grow with the length of a text, and no text is shortened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes handled at a time.
PIECE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators) -> np.ndarray:
    """Value of each byte in a word, upper case A-Z as lower case; 0 for separators."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


# Words `[^\x20\x09-\x0D]+`.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
# Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower case: letters, digits and all non-ASCII.
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest piece needs."""

    base = 0x5851F42D4C957F2D
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            cls.up = cls._row(cls.base, size)
            cls.down = cls._row(pow(cls.base, -1, 1 << 64), size)
        return cls.up, cls.down

    @staticmethod
    def _row(base: int, size: int) -> np.ndarray:
        row = np.ones(1, np.uint64)
        while len(row) < size:
            row = np.concatenate([row, row * np.uint64(pow(base, len(row), 1 << 64))])
        return row


def _piece(data: np.ndarray, firsts: np.ndarray, table: np.ndarray):
    """Starts and hashes of the words in ``data``; ``firsts`` are the places where a document begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = table[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if len(firsts):
        begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _Powers.get(len(data))
    sums = np.add.reduceat(values * up[: len(data)], starts)
    return starts, mix(sums * down[starts])


def _cuts(data: np.ndarray, table: np.ndarray):
    """Pieces of one long text, each ending at a separator or at the end."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(table[data[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece: up to its end
                while end < len(data):
                    gaps = np.flatnonzero(table[data[end:end + PIECE]] == 0)
                    if len(gaps):
                        end += int(gaps[0]) + 1
                        break
                    end = min(end + PIECE, len(data))
        yield at, end
        at = end


def documents_words(texts: pa.Array, table: np.ndarray):
    """Yield ``(first row, hashes, bounds)`` for runs of rows.

    The words of row ``first + i`` have the hashes ``hashes[bounds[i]:bounds[i + 1]]``; null has none. Equal words have
    equal hashes; different words differ up to the chance of a 64-bit collision.
    """
    for first, hashes, bounds, _ in documents_lines(texts, table):
        yield first, hashes, bounds


def documents_lines(texts: pa.Array, table: np.ndarray):
    """As :func:`documents_words`, with the number of line feeds before each word (counted from anywhere above it)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1].copy()
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        lo, hi = offsets[row], offsets[stop]
        if stop == row + 1 and hi - lo > PIECE:
            parts, feeds, before = [], [], 0
            for a, b in _cuts(data[lo:hi], table):
                part = data[lo + a:lo + b]
                starts, hashes = _piece(part, np.zeros(0, np.int64), table)
                ends = np.flatnonzero(part == 10)
                parts.append(hashes)
                feeds.append(before + np.searchsorted(ends, starts))
                before += len(ends)
            hashes = np.concatenate(parts)
            yield row, hashes, np.array([0, len(hashes)]), np.concatenate(feeds)
        else:
            firsts = offsets[row:stop] - lo
            starts, hashes = _piece(data[lo:hi], firsts[firsts < hi - lo], table)
            feeds = np.searchsorted(np.flatnonzero(data[lo:hi] == 10), starts)
            yield row, hashes, np.searchsorted(starts, offsets[row:stop + 1] - lo), feeds
        row = stop


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; positions near the end of a document are the caller's to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total *= np.uint64(_Powers.base)
        total += hashes[i:i + count]
    return mix(total)
