import random
import re

from corpuscope.llm.pii import em, find_spans, fit_classifier, luhn
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and passes_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng, n=16):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if passes_luhn(body + c))


def texts():
    rng = random.Random(6)
    alphabet = "aZ09.@-+_% ()\n漢🙂é\x01\x02\x03!="
    some = ["".join(rng.choices(alphabet, k=rng.randrange(0, 80))) for _ in range(400)]
    digits = ["".join(rng.choices("0123456789. -+(", k=60)) for _ in range(300)]
    made = [f"x {card(rng)} y", f"{card(rng)} {card(rng)}", "4111 1111 1111 1111", "a.b@c.d.e@f.g", "a@b", "a@b.c_d@e.f", "é a@b.c@d.e.f-",
            "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255 000256.1.1.1", "+1 (555) 123-4567.", "++49 30 1234567 8", "+1 2", "..a..@b..c.d",
            "a\x02b@c.d \x0212.3.4.5", "1\x012 " + card(rng), "🙂" * 5 + "me@host.org" + "漢", "9" * 30000, "a@" + "b." * 9000 + "c", "1 " * 20000, "a" * 50000 + "@"]
    return [None, "", *made, *some, *digits]


def test_base_equals_patterns(spark):
    rows = list(enumerate(texts()))
    got = find_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute(rows[r.doc_id][1]), repr(rows[r.doc_id][1])[:200]
        assert {(s.kind, s.start, s.end) for s in r.base} <= {(s.kind, s.start, s.end) for s in r.spans}
        for s in r.spans:
            assert rows[r.doc_id][1][s.start:s.end] == s.value


def test_method_adds_spans(spark):
    rng = random.Random(7)
    rows = [(i, f"call me, phone ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} or mail ann{i} [at] host [dot] org now") for i in range(40)]
    rows += [(100 + i, f"pay by card {card(rng)} {card(rng)} today, write to me{i}@mail.com") for i in range(40)]
    rows += [(200 + i, f"nothing here {i} but 12.50 and 2021-03-04") for i in range(40)]
    got = {r.doc_id: r for r in find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all({s.kind for s in got[i].spans} == {"phone", "email"} and not got[i].base for i in range(40))
    assert all(len([s for s in got[100 + i].spans if s.kind == "card"]) == 2 and len(got[100 + i].base) == 1 for i in range(40))
    assert all(not got[200 + i].spans for i in range(40))


def test_repeats_empty_and_names(spark):
    kind = "doc_id bigint, text string, lists int, row string, kind string"
    df = spark.createDataFrame([(1, "a@b.c", 1, "r", "k")] * 3 + [(None, "a@b.c", 1, "r", "k")], kind)
    got = find_spans(df).collect()
    assert len(got) == 4 and all(len(r.base) == 1 for r in got)
    assert find_spans(df.limit(0)).count() == 0


def test_luhn(spark):
    rng = random.Random(1)
    numbers = ["".join(rng.choices("0123456789", k=rng.randrange(1, 20))) for _ in range(200)] + [""]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select(luhn(F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [bool(n) and passes_luhn(n) for n in numbers]


def test_em_finds_reliabilities():
    rng = random.Random(2)
    counts, truth = {}, {}
    for _ in range(5000):
        real = rng.random() < 0.3
        vote = tuple((1 if (rng.random() < acc) == real else -1) if rng.random() < 0.8 else 0 for acc in (0.95, 0.85, 0.8, 0.55))
        counts[vote] = counts.get(vote, 0) + 1
        truth[vote] = truth.get(vote, 0) + real
    posterior = em(sorted(counts.items()))
    right = sum(truth[v] if posterior[v] >= 0.5 else counts[v] - truth[v] for v in counts)
    best = sum(max(truth[v], counts[v] - truth[v]) for v in counts)
    assert right >= 0.98 * best and em([]) == {}


def test_classifier():
    w = fit_classifier([((1, 0), 0.95, 50), ((0, 1), 0.05, 50), ((0, 0), 0.1, 20)], 2)
    assert w[0] + w[1] > 0 > w[0] + w[2] and fit_classifier([], 2) == (0.0, 0.0, 0.0)
