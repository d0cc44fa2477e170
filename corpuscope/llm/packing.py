"""Pack tokenized documents into sequences of fixed length: sum-of-squares packing over residual gaps."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import _Powers, mix
from corpuscope.session import staged

CAPACITY = 2048
END = 0
# Bytes cut at a time, and distinct chunks remembered in a task.
PIECE = 1 << 20
REMEMBERED = 1 << 20
# Pieces and tokens that one task packs.
GROUP_PIECES = 1 << 16
GROUP_TOKENS = 1 << 25

# A line that can stand before any visible text without changing its ids.
LINE = b" .\n"
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# Bytes after which it is certain that no white space, no rest of it and no special token begins: everything but
# control characters, the space, `<`, and the first bytes of characters among which Unicode has white space.
_FOLLOWS = np.ones(256, bool)
_FOLLOWS[[*range(0x21), 0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?'\")")] = True


def chunk_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places at which the bytes of some texts can be cut without changing their byte-level BPE ids.

    Such a tokenizer begins a word at the last space of a run when something visible follows, never joins one line feed
    to the visible text around it, and ends a word of letters at a mark. ``firsts`` are the places where a text begins;
    all of them are cuts.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    visible = _FOLLOWS[data]
    cut[:-1] = (data[:-1] == 0x20) & visible[1:]
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[2:] |= (data[1:-1] == 0x0A) & _SOLID[data[:-2]] & visible[2:]
    # The byte after the last one of a text belongs to the next.
    cut[firsts[firsts > 0] - 1] &= data[firsts[firsts > 0] - 1] != 0x20
    cut[firsts] = True
    return np.flatnonzero(cut)


class ChunkIds:
    """Ids of chunks by their hash: each different chunk is tokenized once while it is remembered."""

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        self.sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of an id; a byte is one character in a token
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(token.content.encode())
            if set(token.content.encode()) & {0x0A, 0x20, *np.flatnonzero(_MARK)}:
                raise ValueError(f"texts are cut within the special token {token.content!r}")
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def encode_chunks(self, chunks: list[bytes]):
        """Ids of all chunks in one row, and the number of ids of each.

        Chunks are tokenized as one text where they may follow each other: at a space, or after ``LINE``, which is cut
        out again. The bytes of the ids tell where a chunk ends.
        """
        parts, own, odd = [], [], {}
        for i, chunk in enumerate(chunks):
            if chunk[0] == 0x20 and len(chunk) > 1 and _FOLLOWS[chunk[1]]:
                parts.append(chunk)
                own.append(i)
            elif _FOLLOWS[chunk[0]]:
                parts += [LINE, chunk]
                own += [-1, i]
            else:
                odd[i] = self.encode(chunk)
        ids = self.encode(b"".join(parts)) if parts else np.zeros(0, np.uint32)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x) for x in parts]), side="right")
        begins = np.append(0, ends[:-1])
        counts = np.zeros(len(chunks), np.int64)
        own = np.array(own, np.int64)
        counts[own[own >= 0]] = (ends - begins)[own >= 0]
        if not odd and (own >= 0).all():
            return ids, counts
        found = [ids[a:b] for i, a, b in zip(own, begins, ends) if i >= 0]
        for i, some in odd.items():
            counts[i] = len(some)
            found.insert(i, some)
        return np.concatenate(found), counts

    def of(self, data: np.ndarray, starts: np.ndarray):
        """Ids of all chunks of ``data`` in one row, and the number of ids of each."""
        up, down = _Powers.get(len(data))
        hashes = mix(np.add.reduceat(_VALUES[data] * up[: len(data)], starts) * down[starts])
        keys, first, chunk = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.remembered:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            ends = np.append(starts[1:], len(data))
            raw = data.tobytes()
            ids, lengths = self.encode_chunks([raw[starts[i]:ends[i]] for i in first[new]])
            total = len(ids)
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used, 1 << 16), np.uint32)])
            self.pool[self.used:self.used + total] = ids
            begins = self.used + np.cumsum(lengths) - lengths
            self.used += total
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.starts = np.insert(self.starts, at[new], begins)
            self.lengths = np.insert(self.lengths, at[new], lengths)
            at = np.searchsorted(self.keys, keys)
        counts = self.lengths[at][chunk]
        shift = self.starts[at][chunk] - (np.cumsum(counts) - counts)
        return self.pool[np.repeat(shift, counts) + np.arange(int(counts.sum()))], counts


def _long_text(data: np.ndarray, chunks: ChunkIds) -> np.ndarray:
    """Ids of one text longer than a piece, cut at chunks; a chunk that is longer itself is tokenized alone."""
    starts = np.append(chunk_starts(data, np.zeros(1, np.int64)), len(data))
    parts, i = [], 0
    while i < len(starts) - 1:
        j = int(np.searchsorted(starts, starts[i] + PIECE, side="right")) - 1
        if j <= i:
            parts.append(chunks.encode(data[starts[i]:starts[i + 1]].tobytes()))
            j = i + 1
        else:
            parts.append(chunks.of(data[starts[i]:starts[j]], starts[i:j] - starts[i])[0])
        i = j
    return np.concatenate(parts)


def texts_ids(texts: pa.Array, chunks: ChunkIds):
    """Yield ``(row, ids)`` for every text; null has none."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1].copy()
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        data = whole[offsets[row]:offsets[stop]]
        if len(data) > PIECE:
            yield row, _long_text(data, chunks)
        elif not len(data):
            for i in range(row, stop):
                yield i, np.zeros(0, np.uint32)
        else:
            bounds = offsets[row:stop + 1] - offsets[row]
            starts = chunk_starts(data, bounds[:-1][bounds[:-1] < len(data)])
            ids, counts = chunks.of(data, starts)
            ends = np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]
            for i in range(row, stop):
                yield i, ids[ends[i - row]:ends[i - row + 1]]
        row = stop


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
                 special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids of a byte-level BPE file, each ended by ``end``, cut into pieces of at most ``capacity``.

    Returns ``<id_col>, piece, start, length, ids_crc32`` and, on request, ``ids`` (array<int>). Only a document of
    more than ``capacity`` ids is cut; all its pieces but the first are full. Null and empty texts are the end id alone.
    Rows that repeat an id or a whole row are documents of their own; a null id stays null. Strings of special tokens
    count as those unless ``special_as_text``. An empty table gives an empty result; other columns are not looked at.

    The file is read on the driver and sent to the tasks (a vocabulary of fixed size). A task holds the ids of one
    megabyte of text, or of one longer text, and remembers up to ``REMEMBERED`` different chunks by a 64-bit hash.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    key = docs.schema[id_col].dataType
    kind = f"id {key.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        tokenizer.encode_special_tokens = special_as_text
        chunks = ChunkIds(tokenizer)
        for batch in batches:
            found = []
            for row, ids in texts_ids(batch.column("text"), chunks):
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                at, size = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while at < len(ids):
                    own = ids[at:at + size]
                    found.append((row, piece, at, len(own), zlib.crc32(own.tobytes()),
                                  own.astype(np.int32) if with_ids else None))
                    at, size, piece = at + size, capacity, piece + 1
            rows, piece, start, length, crc, own = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array(own, pa.list_(pa.int32()))], ["id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, kind)
    return pieces.withColumnRenamed("id", id_col) if with_ids else pieces.drop("ids").withColumnRenamed("id", id_col)


def pack_lengths(lengths: np.ndarray, capacity: int):
    """Sum-of-squares packing of lengths below ``capacity``: the sequence and the offset of each.

    Longest first, each goes where the sum over all gaps of the squared number of open sequences with that gap becomes
    smallest (ties: the smaller gap); a new sequence is opened only when none has room, since opening by the
    sum alone costs about one sequence in a hundred here. The work per piece is one look at all gaps.
    """
    opened = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = np.flatnonzero(opened[size:capacity])
        if len(fits):
            # One less of n sequences with a gap changes the sum by 1 - 2n, one more of n by 1 + 2n; gap 0 is closed.
            change = np.where(fits > 0, 2 + 2 * opened[fits], 1) - 2 * opened[size + fits]
            gap = size + int(fits[np.argmin(change)])
            opened[gap] -= 1
            place = stacks[gap].pop()
        else:
            gap, place = capacity, used
            used += 1
        sequence[i], offset[i] = place, capacity - gap
        if gap > size:
            opened[gap - size] += 1
            stacks[gap - size].append(place)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", group_pieces: int = GROUP_PIECES,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (underscores in front while a name is taken).

    A piece of ``capacity`` is a sequence of its own (negative numbers). The others are dealt out in turn to groups of
    about ``group_pieces`` pieces and ``group_tokens`` tokens, and each group is packed in one task by
    :func:`pack_lengths`; every group sees the same mix of lengths and leaves a few sequences open, so the result is
    about one in ten thousand above one packing of all. Equal rows are pieces of their own. ``pieces`` must come from a
    written table, as dealing goes by place in it.
    """
    number, place, group = fresh(pieces, "sequence_id"), fresh(pieces, "offset"), fresh(pieces, "group")
    length = col(length_col)
    n, tokens = pieces.where(length < capacity).agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    groups = max(1, -(-n // group_pieces), -(-tokens // group_tokens))
    row = F.monotonically_increasing_id()
    whole = pieces.where(length == capacity).select("*", (-1 - row).alias(number), F.lit(0).cast("bigint").alias(place))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        own = table.column(group)[0].as_py()
        sequence, offset = pack_lengths(table.column(length_col).to_numpy(), capacity)
        table = table.drop_columns([group])
        return table.append_column(number, pa.array(sequence + (own << 32))).append_column(place, pa.array(offset))

    dealt = pieces.where(length < capacity).withColumn(group, F.pmod(row, F.lit(groups)))
    return dealt.groupBy(col(group)).applyInArrow(run, fields).unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
                   special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of :func:`token_pieces` with their place in a sequence, see :func:`pack`."""
    pieces = token_pieces(docs, tokenizer_file, capacity, end, with_ids, special_as_text, id_col, text_col)
    return pack(staged(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, input_ids, lengths`` (ids in order, lengths of the pieces).

    ``packed`` is a result of :func:`pack_documents` with ids; a sequence has at most its capacity of ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"),
        F.transform("parts", lambda p: p["length"]).alias("lengths"))
