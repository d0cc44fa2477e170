"""Personal data: labelers vote on candidate spans, EM estimates how far to trust them, a classifier decides. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import col
from corpuscope.session import staged

KINDS = ["email", "ip", "card", "phone"]
# Characters kept on either side of a candidate for the context labelers.
CONTEXT = 32
# A candidate that is not a base span is added from this probability on.
ACCEPT = 0.5

# Base patterns. Inside words of digits and domains, separators that belong are first replaced one for one
# (a space in a card by \u0001, a hyphen by \u0004, a dot in a domain by \u0002), so that each pattern repeats single characters only and long runs need no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x02-]))[A-Za-z0-9._%+\x02-]+@[A-Za-z0-9-]+\x02[A-Za-z0-9\x02-]+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9\x01\x04]{13,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Wider patterns: spans that the base rules miss.
SPELLED_EMAIL = (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
                 r" ?[\[(]dot[\])] ?[A-Za-z]{2,24}(?![A-Za-z0-9])")
LOCAL_PHONE = r"(?<![0-9+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
PLAIN_CARD = r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9.-])"
WIDE = [("email", SPELLED_EMAIL), ("phone", LOCAL_PHONE), ("card", PLAIN_CARD)]

# Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "co"]
CARD_PREFIXES = ["4", "51", "52", "53", "54", "55", "34", "37", "6011", "65"]
# Cue words by kind, looked for before the span.
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "write", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "addr", "login"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "telefon", "llamar"],
}

# Steps of expectation-maximisation and of the classifier's fit.
EM_STEPS = 50
FIT_STEPS = 200


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    def part(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i))
    return (n > 0) & (total % 10 == 0)


def _marked(text: Column, kind: str) -> Column:
    """Text of the same length in which the separators inside a span of the kind are control characters."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, "\u0002", "\u0003"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\u0002")
    if kind == "card":
        spaced = F.regexp_replace(F.translate(text, "\u0001\u0004", "\u0003\u0003"), r"(?<=[0-9]) (?=[0-9])", "\u0001")
        return F.regexp_replace(spaced, r"(?<=[0-9])-(?=[0-9])", "\u0004")
    return text


def _pieces(text: Column, kind: str, pattern: str, base: bool, needed: Column) -> Column:
    """All matches as ``array<struct<kind, base, gap, n, value, before, after>>``; ``gap`` is the text before a match since the last."""
    marked = _marked(text, kind) if base else text
    gaps = F.split(marked, pattern, -1)
    values = F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))

    def shown(value):
        return F.translate(value, "\u0001\u0004\u0002", " -.") if base else value

    found = F.transform(values, lambda v, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"),
        F.length(F.get(gaps, i)).cast("bigint").alias("gap"), F.length(v).cast("bigint").alias("n"), shown(v).alias("value"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))
    return F.when(needed, found)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: its id, a row number and the matches of all patterns, without the text."""
    text = F.coalesce(col(text_col), F.lit(""))
    digits = text.rlike("[0-9][ ().-]?[0-9]")
    lists = [
        _pieces(text, "email", EMAIL, True, F.contains(text, F.lit("@"))),
        _pieces(text, "ip", IP, True, text.rlike(r"[0-9]\.[0-9]+\.[0-9]")),
        _pieces(text, "card", CARD, True, digits),
        _pieces(text, "phone", PHONE, True, F.contains(text, F.lit("+"))),
        _pieces(text, "email", SPELLED_EMAIL, False, text.rlike(r"(?i)[\[(]at[\])]")),
        _pieces(text, "phone", LOCAL_PHONE, False, digits),
        _pieces(text, "card", PLAIN_CARD, False, digits),
    ]
    kind = "array<struct<kind:string,base:boolean,gap:bigint,n:bigint,value:string,before:string,after:string>>"
    none = F.array().cast(kind)
    found = docs.select(col(id_col).alias("id"), F.array(*[F.coalesce(x, none) for x in lists]).alias("lists"))
    return found.withColumn("row", F.monotonically_increasing_id())


def spans(scanned: DataFrame) -> DataFrame:
    """Candidates with places: (row, kind, start, end, base, value, before, after); failing matches of the base are gone.

    Places are running sums over the matches of a document, in code points; the end is exclusive.
    """
    each = scanned.where(F.exists("lists", lambda x: F.size(x) > 0)).select("row", F.posexplode("lists").alias("pattern", "found"))
    each = each.select("row", "pattern", F.posexplode("found").alias("nth", "m"))
    so_far = Window.partitionBy("row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(so_far)
    placed = each.select("row", "pattern", "m.kind", "m.base", (end - F.col("m.n")).alias("start"), end.alias("end"),
                         "m.value", "m.before", "m.after")
    digits = F.regexp_replace("value", "[^0-9]", "")
    many = F.length(digits)
    # A number of more than nine digits is above 255 unless it starts with zeros.
    small = F.forall(F.split("value", r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    at_most = F.forall(F.split("value", r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255)
    valid = (
        F.when(F.col("kind") == "ip", small & at_most)
        .when((F.col("kind") == "card"), many.between(13, 19) & luhn(digits))
        .when((F.col("kind") == "phone") & F.col("base"), many.between(9, 15))
        .otherwise(F.lit(True)))
    return _apart(placed.where(valid))


def _apart(placed: DataFrame) -> DataFrame:
    """Without the spans of wider patterns that overlap a base span of any kind, or an earlier one of their own."""
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "pattern")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    following = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.col("end"))
    free = F.col("base") | ((reached <= F.col("start")) & (following >= F.col("end")))
    return placed.withColumn("free", free).where("free").drop("free", "pattern")


def _has(text: Column, words) -> Column:
    pattern = r"(?i)(?<![\p{L}])(?:" + "|".join(words) + r")(?![\p{L}])"
    return text.rlike(pattern)


def votes(candidates: DataFrame) -> DataFrame:
    """Votes of the labelers on each candidate: 1 for personal data, -1 against, 0 none.

    Two regular expressions (base form; clean ends, no letters or digits on either side), two gazetteers (known domain or
    card prefix or number range; doubtful values such as one repeated digit), two of context (cue word of its
    own kind; cue word of another kind).
    """
    value, kind, before, after = F.col("value"), F.col("kind"), F.col("before"), F.col("after")
    digits = F.regexp_replace(value, "[^0-9]", "")
    regex = F.when(F.col("base"), 1).otherwise(0)
    torn = before.rlike(r"[\p{L}\p{N}_=/\"]$") | after.rlike(r"^[\p{L}\p{N}_=/\"]")
    edges = F.when(torn, -1).otherwise(1)
    known = (
        F.when((kind == "email"), F.when(F.lower(value).rlike(r"(?:\.|dot[\])] ?)(?:" + "|".join(DOMAINS) + r")$"), 1).otherwise(0))
        .when(kind == "card", F.when(digits.rlike("^(?:" + "|".join(CARD_PREFIXES) + ")"), 1).otherwise(0))
        .when(kind == "ip", F.when(value.rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
        .otherwise(F.when(digits.rlike("^(?:1?[2-9]|[2-9])"), 1).otherwise(0)))
    odd = F.when(F.length(F.replace(digits, F.left(digits, F.lit(1)), F.lit(""))) == 0,
                 F.when(kind == "email", 0).otherwise(-1)).otherwise(0)
    own = reduce(lambda w, k: w.when((kind == k) & _has(before, CUES[k]), 1), KINDS, F.when(F.lit(False), 0)).otherwise(0)
    others = reduce(lambda w, k: w.when((kind != k) & _has(before, CUES[k]), -1), KINDS, F.when(F.lit(False), 0)).otherwise(0)
    return candidates.withColumns({f"v{i}": v.cast("int") for i, v in enumerate([regex, edges, known, odd, own, others])})


N_VOTES = 6


def features(voted: DataFrame) -> DataFrame:
    """Yes-or-no features of a span for the final classifier, beside its kind."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    marks = {
        "f0": F.col("base"), "f1": F.length(value) > 16, "f2": digits >= 10, "f3": value.rlike("[ .-]"),
        "f4": before.rlike(r"(?:^|\s)$"), "f5": after.rlike(r"^(?:$|\s|[.,;!?])"), "f6": value.rlike("[()]"),
        "f7": F.col("v4") > 0, "f8": F.col("v1") < 0, "f9": F.col("v2") > 0,
    }
    return voted.withColumns({n: c.cast("int") for n, c in marks.items()})


N_FEATURES = 10


def em(patterns: list, steps: int = EM_STEPS) -> dict:
    """Posterior of each vote pattern, by expectation-maximisation (Dawid and Skene, two classes, votes may be missing).

    ``patterns`` are (votes, count) of one kind. It starts from the majority of votes; a labeler's reliabilities are
    the smoothed shares of its votes 1 and -1 among spans of either class.
    """
    if not patterns:
        return {}
    p = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    for _ in range(steps):
        total = sum(n for _, n in patterns)
        yes = sum(p[v] * n for v, n in patterns)
        prior = min(0.999, max(0.001, (yes + 1.0) / (total + 2.0)))
        given = []
        for j in range(len(patterns[0][0])):
            rates = {}
            for vote in (-1, 1):
                real = sum(p[v] * n for v, n in patterns if v[j] == vote)
                false = sum((1 - p[v]) * n for v, n in patterns if v[j] == vote)
                # Smoothing says that a labeler is a little better than chance until counts say otherwise.
                rates[vote] = ((real + (2.0 if vote > 0 else 0.5)) / (yes + 3.0), (false + (0.5 if vote > 0 else 2.0)) / (total - yes + 3.0))
            given.append(rates)
        for v, _ in patterns:
            z = math.log(prior / (1 - prior))
            z += sum(math.log(given[j][x][0] / given[j][x][1]) for j, x in enumerate(v) if x)
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return p


def fit_classifier(rows: list, n: int, steps: int = FIT_STEPS, ridge: float = 0.1) -> tuple:
    """Logistic weights (bias first) from (features, soft label, count) by gradient steps with a ridge penalty."""
    w = [0.0] * (n + 1)
    total = sum(c for _, _, c in rows)
    if not total:
        return tuple(w)
    for step in range(steps):
        g = [ridge * x / max(1.0, total) for x in w]
        for f, y, c in rows:
            x = (1.0, *f)
            e = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - y) * c / total
            g = [a + e * b for a, b in zip(g, x)]
        w = [a - 2.0 * b for a, b in zip(w, g)]
    return tuple(w)


def learn(candidates: DataFrame) -> dict:
    """Weights of the span classifier by kind, learned from the votes on all candidates.

    Spark counts how often each pattern of votes and features occurs; there are at most 4 * 3^6 * 2^10 of those,
    whatever the size of the corpus, and only these counts come to the driver.
    """
    names = [f"v{i}" for i in range(N_VOTES)] + [f"f{i}" for i in range(N_FEATURES)]
    counted = features(votes(candidates)).groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    models = {}
    for kind in KINDS:
        rows = [(tuple(r[n] for n in names[:N_VOTES]), tuple(r[n] for n in names[N_VOTES:]), r["n"]) for r in counted if r["kind"] == kind]
        by_vote: dict = {}
        for v, _, n in rows:
            by_vote[v] = by_vote.get(v, 0) + n
        posterior = em(sorted(by_vote.items()))
        models[kind] = fit_classifier([(f, posterior[v], n) for v, f, n in sorted(rows)], N_FEATURES)
    return models


def probability(models: dict) -> Column:
    """Probability that a span is personal data, over the columns of :func:`features`."""
    def of(weights):
        total = reduce(lambda t, k: t + F.col(f"f{k}") * F.lit(weights[k + 1]), range(N_FEATURES), F.lit(weights[0]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    return reduce(lambda w, k: w.when(F.col("kind") == k, of(models[k])), KINDS, F.when(F.lit(False), 0.0))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Spans of personal data of every row of ``docs``.

    Returns ``<id_col>, base, spans``: arrays of struct(kind, start, end, value, probability) in the order of
    ``KINDS``, then start. ``base`` are the matches of the base patterns that hold (leftmost, not overlapping within a
    kind; checks on range, digits and Luhn, failing matches dropped); ``spans`` are those and the candidates of wider
    patterns that overlap no base span of any kind and that the classifier takes for personal data. Null counts as
    empty; rows that repeat are scanned each by itself. The arrays of a row grow with its own text only.
    """
    scanned = staged(scan(docs, id_col, text_col), "scanned")
    candidates = staged(spans(scanned), "candidates")
    models = learn(candidates)
    scored = features(votes(candidates)).withColumn("probability", probability(models))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    item = F.struct(rank.alias("rank"), "start", "end", "kind", "value", "probability")
    kept = scored.where(F.col("base") | (F.col("probability") >= accept))
    merged = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("base"),
                                     F.sort_array(F.collect_list(item)).alias("spans"))

    def shape(name):
        kind = "array<struct<kind:string,start:bigint,end:bigint,value:string,probability:double>>"
        return F.coalesce(F.transform(name, lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], s["probability"])).cast(kind),
                          F.array().cast(kind)).alias(name)

    return scanned.select("row", "id").join(merged, "row", "left").select(F.col("id").alias(id_col), shape("base"), shape("spans"))


def digest(spans_col: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
