import math
import random
import re
from collections import Counter, defaultdict

from corpuscope.llm.mixing import mix_copies, mix_sources, source_targets

KIND = "doc_id bigint, text string, source string, copies int, copy string, text_hash int"


def documents(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "b", "b", "b", "a", "c", "ä", "", None, "Z"])
        n = rng.choice([0, 1, 1, 3, 8, 30]) if i % 97 else 400
        rows.append((i, rng.choice(["w ", "w\t", "w\n\x0b", "w x "]) * n if i % 50 else None, source, i, "x", 1))
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > most * sizes[s] + 1e-9]
        if not above:
            target.update({s: left * weight[s] / whole for s in open_})
            break
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= set(above)
    return target


def test_targets(spark):
    rng = random.Random(9)
    for k in (1, 2, 5, 17):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 5000]) for i in range(k)}
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_copies(spark):
    rows = documents()
    got = mix_copies(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    target = brute_targets(dict(sizes))
    taken, longest = Counter(), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r.size == size(by_id[r.id][1]) and r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate) <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * longest[s]
    again = mix_copies(spark.createDataFrame(rows[::-1], KIND).repartition(3)).collect()
    assert sorted((r.id, r.taken) for r in got) == sorted((r.id, r.taken) for r in again)


def test_mix_and_names(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, KIND)
    mixed = mix_sources(docs)
    assert mixed.columns == [*docs.columns, "_copy"]
    copies = {r.id: r.copies for r in mix_copies(docs).collect() if r.copies}
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == Counter(copies)
    assert all(1 <= r._copy <= copies[r.doc_id] and tuple(r)[:6] == rows[r.doc_id] for r in got)


def test_repeats_nulls_and_empty(spark):
    kind = "doc_id bigint, text string, source string"
    assert mix_sources(spark.createDataFrame([], kind)).count() == 0
    assert mix_copies(spark.createDataFrame([(1, None, "a"), (None, "", None)], kind)).agg({"taken": "sum"}).first()[0] == 0
    rows = [(1, "a b", "s")] * 4 + [(None, "c d", "s")] * 2 + [(2, "a b", "t")]
    counted = sum(r.copies for r in mix_copies(spark.createDataFrame(rows, kind)).collect())
    assert mix_sources(spark.createDataFrame(rows, kind)).count() == counted > 0
