import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuscope.llm import words
from corpuscope.llm.components import components
from corpuscope.llm.words import ALNUM, SPACED, documents_words, grams

PATTERNS = [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts():
    rng = random.Random(3)
    letters = "aAbZz09 .\n\t,éÉß漢🙂 -_|"
    some = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(200)]
    return [None, "", " ", "x", *some, "w" * 500, "ab " * 400, None]


@pytest.mark.parametrize("table,pattern", PATTERNS)
@pytest.mark.parametrize("piece", [16, 64, 1 << 20])
def test_words_equal_the_pattern(monkeypatch, table, pattern, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    want = [re.findall(pattern, lower(t or "")) for t in texts()]
    got = {}
    for first, hashes, bounds in documents_words(pa.array(texts()), table):
        for i in range(len(bounds) - 1):
            got[first + i] = hashes[bounds[i]:bounds[i + 1]].tolist()
    assert sorted(got) == list(range(len(want)))
    name = {}
    for i, own in enumerate(want):
        assert len(got[i]) == len(own)
        for word, h in zip(own, got[i]):
            assert name.setdefault(word, h) == h
    assert len(set(name.values())) == len(name)


def test_sliced_and_empty_arrays():
    array = pa.array(["zero", "a b", None, "c"]).slice(1)
    runs = list(documents_words(array, SPACED))
    assert [r[0] for r in runs] == [0] and runs[0][2].tolist() == [0, 2, 2, 3]
    assert list(documents_words(pa.array([], pa.string()), SPACED)) == []


def test_grams():
    h = np.arange(10, dtype=np.uint64)
    assert len(grams(h, 4)) == 7 and len(grams(h[:3], 4)) == 0
    assert grams(h, 3)[2] == grams(h[2:], 3)[0] and grams(h, 2)[0] != grams(h[::-1].copy(), 2)[8]


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            r, s = sorted((root(a), root(b)))
            parent[s] = r
    lowest = {}
    for x in parent:
        lowest[root(x)] = min(lowest.get(root(x), x), x)
    return {x: lowest[root(x)] for x in parent}


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(9000, i) for i in range(1, 60)]
    other = [(rng.randrange(20000, 20080), rng.randrange(20000, 20080)) for _ in range(60)]
    edges = path + star + other + path[:3] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == brute_components(edges) and len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
