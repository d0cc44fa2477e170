import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpuscope.llm import packing
from corpuscope.llm.packing import ChunkIds, pack_documents, pack_lengths, sequences, texts_ids, token_pieces

FILE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t\r ab'sA1.!,<|>éß日本　  \u0085\x00\x1c“", "  ", "\n\n", "'s", "'ll", "<|endoftext|>", " <|endoftext|>"]
RNG = random.Random(5)
FUZZ = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randrange(40))) for _ in range(3000)]
TEXTS = [None, "", " ", "one two", "one two", "word " * 700, "日本" * 900, "x" * 5000, "The end.\n\nNew line, isn't it?", "a<|endoftext|>b"]
ROWS = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(TEXTS)] + [(4, "one two", "x", 7)]
KIND = "doc_id bigint, text string, offset string, sequence_id int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_chunks_give_the_ids_of_whole_texts(monkeypatch, tokenizer, as_text, piece):
    monkeypatch.setattr(packing, "PIECE", piece)
    tokenizer.encode_special_tokens = as_text
    want = [e.ids for e in tokenizer.encode_batch(FUZZ, add_special_tokens=False)]
    got = dict(texts_ids(pa.array(FUZZ), ChunkIds(tokenizer, remembered=50)))
    tokenizer.encode_special_tokens = False
    assert [got[i].tolist() for i in range(len(FUZZ))] == want


def slow_packing(lengths, capacity):
    """Sum of squares over all gaps, computed anew for each choice."""
    bins, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for b, gap in sorted(enumerate(bins), key=lambda x: x[1]):
            if gap >= lengths[i]:
                after = bins[:b] + [gap - lengths[i]] + bins[b + 1:]
                counts = defaultdict(int)
                for g in after:
                    counts[g] += g > 0
                total = sum(n * n for n in counts.values())
                if best is None or total < best[0]:
                    best = (total, b)
        if best is None:
            bins.append(capacity)
            best = (0, len(bins) - 1)
        bins[best[1]] -= lengths[i]
        place[i] = best[1]
    return sorted(bins)


def test_sum_of_squares():
    rng = np.random.default_rng(3)
    for n in (0, 1, 30, 120):
        lengths = rng.integers(1, 50, n)
        sequence, offset = pack_lengths(lengths, 50)
        fill = np.bincount(sequence, lengths, minlength=0).astype(int)
        assert sorted(50 - fill) == slow_packing(lengths.tolist(), 50)
        for s in range(len(fill)):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packed_documents(spark, tokenizer, capacity):
    docs = spark.createDataFrame(ROWS, KIND).repartition(3)
    packed = pack_documents(docs, FILE, capacity, with_ids=True)
    rows = packed.collect()
    want = sorted(((i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, t, *_ in ROWS
                   for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids]), key=repr)
    # Pieces of equal ids are told apart by their place, so documents are put together by start.
    by_id = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= capacity
        assert r.piece == 0 or r.length == capacity
        by_id[r.doc_id].append(r)
    got = []
    for i, own in by_id.items():
        firsts = sorted((r for r in own if r.piece == 0), key=lambda r: r.ids)
        rest = [r for r in own if r.piece]
        if len(firsts) == 1:
            ids = [x for r in sorted([*firsts, *rest], key=lambda r: r.start) for x in r.ids]
            got.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        else:
            got += [(i, r.length, r.ids_crc32) for r in firsts]
            assert not rest
    assert sorted(got, key=repr) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= capacity
    assert len(fill) <= -(-sum(r.length for r in rows) // capacity) + 1
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    for s, own in fill.items():
        assert len(whole[s].input_ids) == sum(n for _, n in own) and whole[s].lengths == [n for _, n in own]


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 60), "", 0) for i in range(600)], KIND)
    pieces = token_pieces(docs, FILE, 64)
    one = packing.pack(packing.staged(pieces, "t"), 64).select("sequence_id").distinct().count()
    many = packing.pack(packing.staged(pieces, "t"), 64, group_pieces=50)
    assert many.count() == 600 and one <= many.select("sequence_id").distinct().count() <= one + 24
    none = pack_documents(spark.createDataFrame([], KIND), FILE)
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
