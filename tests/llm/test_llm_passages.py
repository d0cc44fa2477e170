import random
import re

import pyarrow as pa
import pytest

from corpuscope.llm import passages
from corpuscope.llm.passages import repeated_passages, tuned_bands, without_passages


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(rows, n):
    """Ids of the documents that share n words with another one."""
    where = {}
    for i, t in rows:
        own = words(t)
        for k in range(len(own) - n + 1):
            where.setdefault(tuple(own[k:k + n]), set()).add((i, t))
    return {i for found in where.values() if len(found) > 1 for i, _ in found}


def documents(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    planted = [text(rng.choice([51, 55, 60, 90])) for _ in range(6)]
    line = text(12)
    rows = []
    for i in range(80):
        own = text(rng.randrange(20, 200))
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = planted[i % len(planted)]
        if i % 4 == 0:
            own += line
        gaps = [rng.choice([" ", " ", " ", "\n", ".  "]) for _ in own]
        rows.append((i, "".join((w.upper() if rng.random() < 0.05 else w) + (" " if g == ".  " else g) for w, g in zip(own, gaps))))
    return rows + [(500, None), (501, ""), (502, " "), (503, "few words only"), rows[1], (None, rows[3][1])]


def test_planted_passages(spark):
    rows = documents(1)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    flagged = {r.doc_id for r in got}
    # The others share a line of five words or more.
    assert runs(rows, 51) <= flagged <= runs(rows, passages.SHINGLE) | {None}
    by_id = dict(rows)
    for r in got:
        own = words(by_id[r.doc_id])[r.first_word:r.first_word + r.n_words]
        assert len(own) == r.n_words >= passages.SHINGLE and r.class_size > 1
    for c in {r.class_id for r in got}:
        assert sum(not r.removed for r in got if r.class_id == c) == 1 and len({r.doc_id for r in got if r.class_id == c}) > 1


def test_small_chunks_and_buckets(spark, monkeypatch):
    rows = documents(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = sorted(tuple(r) for r in repeated_passages(df.where("doc_id is not null")).drop("class_id").collect())
    monkeypatch.setattr(passages, "CHUNK", 300)
    monkeypatch.setattr(passages, "BUCKET", 200)
    assert sorted(tuple(r) for r in repeated_passages(df.where("doc_id is not null")).drop("class_id").collect()) == want


def test_similar_paragraphs_recall(spark):
    """Of all paragraphs that another document has at a similarity of 0.8 or more, nearly all are found, and no other."""
    rng = random.Random(3)
    rows = []
    for i in range(0, 300, 2):
        own = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([60, 120]))]
        other = list(own)
        for _ in range(rng.choice([1, 2, 3])):
            other[rng.randrange(len(own))] = "x"
        rows += [(i, " ".join(own)), (i + 1, " ".join(other))]
    units = []
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["key", "text"])
    for kind, keys, firsts, n, shingles, cuts in passages.paragraphs(batch, passages.LENGTH, passages.PLACES):
        units += [(int(keys[k]), int(firsts[k]), int(n[k]), kind, set(shingles[cuts[k]:cuts[k + 1]].tolist())) for k in range(len(keys))]
    want = set()
    for u in units:
        for v in units:
            if u[0] // 2 == v[0] // 2 and u[0] != v[0] and u[3] == v[3] and len(u[4] & v[4]) >= 0.8 * len(u[4] | v[4]):
                want.add(u[:3])
    got = {(r.doc_id, r.first_word, r.n_words) for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got <= want and len(want) > 200 and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("chunk", [None, 2000])
def test_similar_paragraphs_among_unlike_ones_with_a_phrase(spark, monkeypatch, chunk):
    """Lines of which most is one phrase fall on the same band keys; only the two of a pair are similar."""
    if chunk:
        monkeypatch.setattr(passages, "CHUNK", chunk)
    rng = random.Random(6)
    phrase, rows = [f"p{k}" for k in range(30)], []
    for i in range(0, 400, 2):
        own = phrase + [f"v{rng.randrange(10**6)}" for _ in range(12)]
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:-1] + ["x"]))]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), places=200)
    of = {r.doc_id: r.class_id for r in found.where("n_words = 42").collect()}
    together = sum(i in of and of[i] == of.get(i + 1) for i in range(0, 400, 2))
    assert together >= 0.98 * 200 and len(set(of.values())) == together


def test_bands():
    for s, r in ((0.8, 0.98), (0.5, 0.9)):
        b = tuned_bands(s, r)
        assert 1 - (1 - s ** 2) ** b >= r > 1 - (1 - s ** 2) ** (b - 1)


def test_cut(spark):
    rows = [r for r in documents(4) if r[0] not in (1, None)]
    kind = "doc_id bigint, text string, firsts int, row string"
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], kind)
    found = repeated_passages(df)
    removed = {}
    for r in found.where("removed").collect():
        removed.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert removed
    out = without_passages(df, found)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        own = words(dict(rows)[r.doc_id])
        assert words(r.text) == [w for k, w in enumerate(own) if k not in removed.get(r.doc_id, ())]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c"), (2, "a b c")]])
def test_nothing_to_find(spark, rows):
    assert repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string, key int") if not rows else
                             spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def test_short_lines_and_hard_wrapped_paragraphs(spark):
    rng = random.Random(11)

    def text(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    licence, rows = " ".join(text(18)), []
    for i in range(6):
        rows.append((i, " ".join(text(7)) + "\n" + licence + "\r\n" + " ".join(text(9))))
    for i in range(100, 180, 2):
        own = text(60)
        other = list(own)
        other[rng.randrange(60)] = "x"

        def wrapped(words, width):
            return "\n".join(" ".join(words[k:k + width]) for k in range(0, 60, width))

        rows += [(i, " ".join(text(12)) + "\n\n" + wrapped(own, 10) + "\n \n" + " ".join(text(12))),
                 (i + 1, " ".join(text(4)) + "\n\n" + wrapped(other, 10 if i % 4 else 60))]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id for r in found if r.n_words == 18} == set(range(6))
    assert sum(not r.removed for r in found if r.n_words == 18) == 1
    whole = {r.doc_id: r.class_id for r in found if r.n_words == 60}
    assert sum(i in whole and whole[i] == whole.get(i + 1) for i in range(100, 180, 2)) >= 0.95 * 40


def test_one_very_long_line(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "short line of just six words")]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_words) for r in found if r.n_words > 100} == {(1, 300_000), (2, 300_001)} and {r.doc_id for r in found} == {1, 2}


def test_edges_of_runs():
    assert passages.edges_of_runs(20, 0.8) == 1 and passages.edges_of_runs(20, 0.95) == 0 and passages.edges_of_runs(100, 0.8) == 0
