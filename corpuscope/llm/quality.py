"""Quality classifier: a sparse ensemble of tree rules over text statistics, scored as Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import SPACED, byte_table, documents_words, grams

# Labelled rows the rules are learned from, at most; the ones with the smallest hash of their id.
SAMPLE = 10_000
TREES = 40
DEPTH = 3
LEAST_LEAF = 20
# Candidate thresholds of a statistic.
CUTS = 32

LINES = byte_table([0x0A])

_LETTERS_UP = list(range(65, 91))
_LETTERS_LOW = list(range(97, 123))
_DIGITS = list(range(48, 58))
_SPACE = [0x20, *range(0x09, 0x0E)]
_STOPS = [ord(c) for c in ".,;:?'\"()-"]
_MARKS = [b for b in range(33, 127) if b not in {*_LETTERS_UP, *_LETTERS_LOW, *_DIGITS, *_STOPS}]

STATISTICS = [
    "log_bytes", "log_words", "upper_share", "digit_share", "stop_share", "mark_share", "bang_share", "bar_share",
    "wide_share", "space_share", "word_bytes", "distinct_words", "top_word", "same_as_before", "repeated_pairs",
    "repeated_fives", "words_per_line", "repeated_lines", "longest_line",
]


def _bytes(text) -> np.ndarray:
    """How often each byte occurs, counted piece by piece."""
    data = np.frombuffer(text, np.uint8)
    total = np.zeros(256, np.int64)
    for i in range(0, len(data), 1 << 20):
        total += np.bincount(data[i:i + (1 << 20)], minlength=256)
    return total


def _repeats(values: np.ndarray) -> float:
    """Share of values that occurred before."""
    return 1.0 - len(np.unique(values)) / len(values) if len(values) else 0.0


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of each text, one column for each name in ``STATISTICS``; zeros for null and empty texts.

    All but the two lengths are shares, so a long text has the values of a short one of its kind.
    """
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts.cast(pa.large_binary())):
        raw = text.as_buffer() if text.is_valid else None
        if raw is None or raw.size == 0:
            continue
        n = _bytes(raw)
        size = raw.size
        up, low = n[_LETTERS_UP].sum(), n[_LETTERS_LOW].sum()
        out[i, 0] = np.log1p(size)
        out[i, 2:10] = [up / max(1, up + low), n[_DIGITS].sum() / size, n[_STOPS].sum() / size, n[_MARKS].sum() / size,
                        n[33] / size, n[124] / size, n[128:].sum() / size, n[_SPACE].sum() / size]
    for first, hashes, bounds in documents_words(texts, SPACED):
        pairs, fives = grams(hashes, 2), grams(hashes, 5)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                continue
            words = hashes[a:b]
            kinds, often = np.unique(words, return_counts=True)
            row = out[first + i]
            row[1] = np.log1p(b - a)
            row[10] = min(100.0, np.expm1(row[0]) / (b - a))
            # Distinct words fall with the length; against its square root texts of all lengths compare.
            row[11] = len(kinds) / np.sqrt(b - a) if b - a > 1 else 1.0
            row[12] = often.max() / (b - a)
            row[13] = np.count_nonzero(words[1:] == words[:-1]) / (b - a)
            row[14] = _repeats(pairs[a:b - 1])
            row[15] = _repeats(fives[a:b - 4])
    for first, hashes, bounds in documents_words(texts, LINES):
        for i in range(len(bounds) - 1):
            lines = hashes[bounds[i]:bounds[i + 1]]
            if len(lines):
                row = out[first + i]
                row[16] = min(1000.0, np.expm1(row[1]) / len(lines))
                row[17] = _repeats(lines)
                row[18] = np.log1p(len(lines))
    return out


def _measure(text_col: str):
    """Arrow function: statistics of the text in each row, beside the row."""

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            values = statistics(row.field(row.type.get_field_index(text_col)))
            ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
            yield pa.record_batch([row, pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["row", "stats"])

    return run


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with an array of statistics added."""
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    measured = packed.mapInArrow(_measure(text_col), f"row {kind}, stats array<double>")
    return measured.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("stats").alias(name))


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: each rule is a tuple of (statistic, above?, threshold), all of which must hold."""

    rules: tuple
    weights: tuple
    intercept: float

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as one expression over the array of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for j, above, cut in rule:
                value = stats[j]
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix(x, self.rules)


def rule_matrix(x: np.ndarray, rules) -> np.ndarray:
    """1 where a rule holds for a row."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, cut in rule:
            out[:, k] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _grow(x, residual, rows, columns, depth, path, rules):
    """Best split of ``rows`` by squared error of the residual; every node below the root is a rule."""
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    best = (1e-9, None, None)
    total, n = residual[rows].sum(), len(rows)
    for j in columns:
        values = x[rows, j]
        order = np.argsort(values, kind="stable")
        sums = np.cumsum(residual[rows][order])
        sorted_values = values[order]
        ends = np.flatnonzero(sorted_values[1:] > sorted_values[:-1]) + 1
        ends = ends[(ends >= LEAST_LEAF) & (ends <= n - LEAST_LEAF)]
        if not len(ends):
            continue
        if len(ends) > CUTS:
            ends = ends[np.linspace(0, len(ends) - 1, CUTS).astype(int)]
        gain = sums[ends - 1] ** 2 / ends + (total - sums[ends - 1]) ** 2 / (n - ends) - total ** 2 / n
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], j, (sorted_values[ends[k] - 1] + sorted_values[ends[k]]) / 2)
    _, j, cut = best
    if j is None:
        return
    for above in (False, True):
        inside = rows[(x[rows, j] > cut) == above]
        rule = (*path, (int(j), above, float(cut)))
        rules.append(rule)
        _grow(x, residual, inside, columns, depth - 1, rule, rules)


def _mean(x, rules_matrix, weights, intercept):
    return 1.0 / (1.0 + np.exp(-(intercept + rules_matrix @ weights)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, steps: int = 400):
    """Logistic weights with an L1 penalty by accelerated proximal gradient steps; the intercept is free."""
    n, k = a.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(a, 2) ** 2 / n + 1.0)
    for _ in range(steps):
        error = _mean(None, a, v, c) - y
        w2 = v - rate * (a.T @ error / n)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * strength, 0.0)
        b2 = c - rate * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Rules:
    """Learn rules from statistics and 0/1 labels.

    Small trees are boosted on bootstrap rows; each path from a root is a conjunctive rule. Rules are weighted by a
    logistic regression with an L1 penalty, picked from a few by the log-loss on a fifth of the rows. With one
    label only, or no rows, there are no rules and the score is the smoothed share of label 1.
    """
    n = len(y)
    share = (y.sum() + 1.0) / (n + 2.0)
    if n == 0 or y.min() == y.max():
        return Rules((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rules: list = []
    score = np.full(n, np.log(share / (1 - share)))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = rng.choice(n, size=max(2 * LEAST_LEAF, n // 2), replace=True)
        columns = rng.choice(x.shape[1], size=max(1, x.shape[1] * 2 // 3), replace=False)
        grown: list = []
        _grow(x, residual, np.sort(rows), columns, depth, (), grown)
        if grown:
            m = rule_matrix(x, grown)
            score = score + 0.3 * m @ np.array([4 * residual[m[:, k] > 0].mean() if m[:, k].any() else 0.0 for k in range(len(grown))]) / depth
        rules.extend(grown)
    rules = list(dict.fromkeys(rules))
    a = rule_matrix(x, rules)
    _, distinct = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows
    rules, a = [rules[k] for k in sorted(distinct)], a[:, sorted(distinct)]
    test = rng.random(n) < 0.2
    if test.all() or not test.any() or y[~test].min() == y[~test].max():
        test = np.zeros(n, bool)
    best = (np.inf, 0.01)
    for strength in (0.03, 0.01, 0.003, 0.001) if test.any() else ():
        w, b = lasso_logistic(a[~test], y[~test], strength, 150)
        p = np.clip(_mean(None, a[test], w, b), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        best = min(best, (loss + 1e-3 * np.count_nonzero(w) / 10, strength))
    w, b = lasso_logistic(a, y, best[1])
    used = np.flatnonzero(np.abs(w) > 1e-3)
    return Rules(tuple(rules[k] for k in used), tuple(float(w[k]) for k in used), float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample: int = SAMPLE) -> Rules:
    """Fit the ensemble on at most ``sample`` rows of ``docs`` that ``labels`` marks; rows with a null label are left out."""
    marked = labels.select(col(id_col).alias("label_id"), col(label_col).cast("double").alias("y")).where("y is not null")
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    # Ids first, then the texts of those that are taken: at most `sample` rows are broadcast.
    chosen = own.select("id").join(marked, F.col("id") == F.col("label_id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = own.join(F.broadcast(chosen.select(F.col("id").alias("chosen"), "y").distinct()), F.col("id") == F.col("chosen"))
    got = with_statistics(rows.select("text", "y")).select("stats", "y").toArrow()
    x = np.array(got["stats"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))
    order = np.lexsort((got["y"].to_numpy(), *x.T))  # the same rows in any order give the same rules
    return fit_rules(x[order], got["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, model: Rules, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` added (underscores in front while the name is taken): the probability of label 1.

    Null and empty texts have statistics of zero and the score of those. Each row is scored by itself; whole texts count.
    """
    stats = fresh(docs, "stats")
    measured = with_statistics(docs, text_col, stats).withColumn(fresh(docs, "score"), model.score(F.col(stats)))
    return measured.drop(stats)


def keep_good(docs: DataFrame, model: Rules, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, all columns as they were."""
    scored = quality_scores(docs, model, text_col)
    return scored.where(col(fresh(docs, "score")) >= least).select(*[col(c) for c in docs.columns])
