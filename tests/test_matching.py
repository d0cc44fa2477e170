import random
import re

import pytest

from corpuscope.operators import matching
from corpuscope.operators.matching import match_terms, pieces_of

RNG = random.Random(7)
WORDS = ["load", "loader", "Über", "naïve", "x", "ab", "日本語", "data_1", "100%", "a\\b", "the", "aaaa"]
TEXTS = [None, "", " "] + [" ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 9))) for _ in range(60)]
TERMS = ["load", "a", "aa", "日本", "語", "", "naïve", "l%d", "l_ad", "%", "_", "data\\_1", "100\\%", "zzz", "oade", "t%e", "%%ab", "x"]


def like(text, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 1
        else:
            out += {"%": ".*", "_": "."}.get(c) or re.escape(c)
        i += 1
    return re.fullmatch(out, text, re.DOTALL) is not None


def brute(rows, literal):
    found = []
    for i, first, second in rows:
        for term in TERMS:
            pattern = not literal and any(c in term for c in "%_\\")
            if any(t is not None and (like(t, f"%{term}%") if pattern else term in t) for t in (first, second)):
                found.append((i, "t", term, (first or "").count(term) if term else 0, len((first or "").split())))
    return sorted(found)


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("at_once, size", [(1 << 15, 1 << 21), (5, 50)])
def test_equals_every_term_on_every_text(spark, monkeypatch, literal, at_once, size):
    monkeypatch.setattr(matching, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(matching, "AT_ONCE_BYTES", size)
    rows = [(i, t and t.lower(), TEXTS[-i].lower() if i % 3 == 0 and TEXTS[-i] else None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id bigint, one string, two string").repartition(3)
    terms = spark.createDataFrame([("t", t) for t in TERMS * 2] + [("t", None)], "kind string, term string")
    got = match_terms(df, ["id"], {"t": ["one", "two"]}, terms, literal).collect()
    assert sorted((r.id, r.kind, r.term, r.n, r.words) for r in got) == brute(rows, literal)


def test_pieces():
    assert len(pieces_of(b"load", True)) == 2 and len(pieces_of(b"ab", True)) == 1 and not len(pieces_of(b"", True))
    assert not len(pieces_of(b"%_", False)) and len(pieces_of(b"%_", True)) == 1
    # The character after an escape is no literal part, and parts shorter than the longest piece are left out.
    assert pieces_of(b"ab%loader", False).tolist() == pieces_of(b"loader", True).tolist()


def test_many_terms_and_kinds(spark):
    df = spark.createDataFrame([(i, f"name_{i} load_{i % 50}") for i in range(500)], "id bigint, text string")
    terms = spark.range(5000).selectExpr("if(id % 2 = 0, 'a', 'b') AS kind", "concat('name_', id, ' ') AS term")
    got = match_terms(df, ["id"], {"a": ["text"], "b": ["text"]}, terms, True).collect()
    assert sorted((r.id, r.kind) for r in got) == [(i, "ab"[i % 2]) for i in range(500)]
    assert match_terms(df, ["id"], {"a": ["text"]}, terms.limit(0)).count() == 0
