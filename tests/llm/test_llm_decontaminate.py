import random
import re

from corpuscope.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        k = min(10, len(own))
        if item is not None and k:
            for i in range(len(own) - k + 1):
                windows.setdefault(tuple(own[i:i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own = words(text)
        hit, found = set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(own) - k + 1):
                names = windows.get(tuple(own[i:i + k]))
                if names:
                    hit.update(range(i, i + k))
                    found |= names
        out.append((doc, len(own), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def case(seed, kinds):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(kinds)]

    def text(n):
        return "".join(rng.choice(vocabulary).upper() + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25, 60]))) for i in range(12)]
    items += [(20, None), (21, ""), (22, " .,"), (None, text(12)), (3, text(15)), (23, items[5][1])]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            own = words(rng.choice(items)[1])
            a = rng.randrange(0, len(own) + 1)
            t += " ".join(own[a:a + rng.choice([8, 9, 10, 12, 40])]) + " " + text(rng.randrange(0, 12))
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, "!"), (5, docs[5][1]), (6, text(30)), (None, items[3][1])], items


def check(spark, docs, items):
    got = contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
                        spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in got.collect()), key=repr) == brute(docs, items)


def test_equals_all_windows(spark):
    check(spark, *case(1, 400))


def test_few_words_and_ties(spark):
    """Two words only: fingerprints repeat and many are equal."""
    check(spark, *case(2, 2))


def test_empty_tables(spark):
    docs, items = case(3, 50)
    check(spark, docs[:5], [])
    assert contamination(spark.createDataFrame([], "doc_id bigint, text string"),
                         spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(300_000))
    check(spark, [(1, long + " " + item[:-4] + " " + long)], [(7, item)])


def test_drop_and_names(spark):
    docs, items = case(4, 300)
    hit = {(d[0], d[1]) for d, b in zip(sorted(docs, key=repr), sorted(docs, key=repr)) if brute([b], items)[0][2] > 0}
    kind = "doc_id bigint, text string, row string, n_hit int, items string, bad_id int"
    table = spark.createDataFrame([(*d, "r", 1, "i", 2) for d in docs], kind)
    kept = drop_contaminated(table, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((d for d in docs if d not in hit), key=repr)
