import random
import re

import pytest

import corpus_pipeline
from corpuscope.llm import ngram_join
from corpuscope.llm.ngram_join import keep_one, near_duplicate_groups, t_occurrence
from tests.llm.test_llm_words import brute_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(4, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1]
             and 100 * len(sets[a][1] & sets[b][1]) >= 85 * len(sets[a][1] | sets[b][1])]
    of = brute_components(links)
    lowest = {}
    for k, c in of.items():
        if sets[k][0] is not None:
            lowest[c] = min(lowest.get(c, sets[k][0]), sets[k][0])
    return sorted(((i, len(s), lowest.get(of[k]) if k in of else i) for k, (i, s) in enumerate(sets)), key=repr)


def documents(seed, groups=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    common = [" ".join(rng.choices(vocabulary, k=25)) for _ in range(3)]
    rows, n = [], 100
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([2, 3, 4, 5, 12, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "\t "]).join(own)
            if rng.random() < 0.4:
                text += " " + rng.choice(common)
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += rng.choice([1, 5])
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a b"), (8, " a  b c "),
                   rows[0], (50, rows[1][1]), (None, rows[2][1]), (None, "nobody has this text at all"), (None, None)]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,shard", [(1, 2000), (2, 3)])
def test_equals_all_pairs(spark, seed, shard):
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(near_duplicate_groups(df, shard=shard)) == brute(rows)


def test_small_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    monkeypatch.setattr(ngram_join, "BUCKET", 300)
    rows = documents(7, 20)
    assert got(near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))) == brute(rows)


def test_copies_in_bulk(spark):
    rng = random.Random(8)
    base = [f"k{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 360):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert got(near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))) == brute(rows)


def test_t_occurrence_equals_all_pairs():
    rng = random.Random(2)
    sets = []
    for _ in range(30):
        base = rng.sample(range(1000), rng.choice([1, 5, 20, 60]))
        for _ in range(3):
            own = set(base)
            for _ in range(rng.choice([0, 1, 3])):
                own.discard(rng.choice(base))
                own.add(rng.randrange(1000, 3000))
            sets.append(own)
    df = {}
    for s in sets:
        for x in s:
            df[x] = df.get(x, 0) + 1
    shared = [sorted((x for x in s if df[x] > 1), key=lambda x: (df[x], x)) for s in sets]
    import numpy as np
    links = list(t_occurrence([len(s) for s in sets], [np.array(s, np.int64) for s in shared], None, 85))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert brute_components(links) == brute_components(want)
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in links)


def test_empty_and_names(spark):
    kind = "doc_id bigint, text string, n bigint, cls string, component_id int"
    empty = spark.createDataFrame([], kind)
    assert near_duplicate_groups(empty).count() == 0 and keep_one(empty).columns == empty.columns
    rows = documents(3, 6)
    table = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], kind)
    kept = keep_one(table)
    want = {(i, c) for i, _, c in brute(rows)}
    gone = {i for i, c in want if c is not None and i != c}
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in gone), key=repr)


def test_keep_one_by_text_leaves_other_texts_of_an_id(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(30)) for k in "abcd")
    rows = [(1, a), (2, a.upper()), (2, b), (3, b), (None, a), (None, c), (None, d), (None, None), (4, None)]
    table = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id bigint, text string, dropped_id int, hash string")
    kept = corpus_pipeline.one_of_similar(spark, table, "")
    want = [(1, a), (2, b), (None, c), (None, d), (None, None), (4, None)]
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_links_lead_through_null_ids(spark):
    base = [f"k{i}" for i in range(100)]

    def changed(*at):
        return " ".join(w if i not in at else "x" for i, w in enumerate(base))

    # 1 - null - 2: the ends differ too much from each other. Then two near copies without any id.
    rows = [(1, changed(99)), (None, changed()), (2, changed(0, 1, 2)), (None, "z " + changed(50, 51, 52, 53, 20, 80)),
            (None, "z " + changed(50, 51, 52, 53, 20, 80, 99))]
    rows[2] = (2, "y y y y y " + changed(0))
    assert got(near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
    assert {c for i, _, c in brute(rows) if i} == {1}
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), by_text=True).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and len(kept) == 2


def test_shards_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD_TOKENS", 400)
    rows = documents(4)
    assert got(near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))) == brute(rows)
