"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.session import staged

# Labelled rows the lexicon is learned from, at most; the ones with the smallest hash of their id.
SAMPLE = 20_000
# Entries and exceptions kept, at most.
ENTRIES = 600
EXCEPTIONS = 2000
# Lengths of the beginnings of words that can be entries besides whole words.
STEMS = range(3, 9)
# Labelled texts an entry has to occur in, and the share of those with label 1 that make a word an entry by itself.
SUPPORT = 4
COMMON = 0.03

# Letters that look like a Latin letter, and digits and signs written for one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k",
    "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(HOMOGLYPHS)
_DIGIT = str.maketrans(SUBSTITUTES)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
# A run of letters with digits or signs among or before them, ended by a letter or digit: `1d10t`, `$tup1d`, `m0r0n`.
_LEET = re.compile(r"(?<![^\W\d_])[@$0134578!]*[^\W\d_][^\W_@$!]*(?:[@$!]+[^\W_]+)*")
_DIGITS_IN = re.compile(r"[0-9@$!]")


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes as plain letters, hidden characters dropped, digits and signs in words as letters.

    Accents stay: they tell words of other languages apart. Numbers stand as they are.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _DIGITS_IN.search(text):
        text = _LEET.sub(lambda m: m[0].translate(_DIGIT) if _DIGITS_IN.search(m[0]) else m[0], text)
    return text


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def terms_of(words: set[str]) -> set[str]:
    """Possible entries of a text: its words, and the beginnings that two or more of its different words share."""
    stems: dict = {}
    for w in words:
        for n in STEMS:
            if len(w) >= n:
                stems[w[:n]] = stems.get(w[:n], 0) + 1
    return words | {s + "*" for s, n in stems.items() if n > 1}


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the calibration of the score.

    An entry ending in ``*`` matches words that begin with it, others match whole words. A match inside an exception
    phrase (words joined by single spaces) does not count. ``score = logistic(bias + slope * log(1 + hits / words^length))``
    where ``hits`` is the sum of the weights of all matches.
    """

    entries: dict
    exceptions: tuple = ()
    bias: float = -2.2
    slope: float = 1.0
    length: float = 0.5

    def automaton(self):
        found = ahocorasick.Automaton()
        patterns: dict = {}
        for entry in self.entries:
            patterns.setdefault(" " + entry[:-1] if entry.endswith("*") else " " + entry + " ", [None, False])[0] = entry
        for phrase in self.exceptions:
            patterns.setdefault(" " + phrase + " ", [None, False])[1] = True
        for pattern, (entry, spared) in patterns.items():
            found.add_word(pattern, (pattern, entry, spared))
        found.make_automaton()
        return found

    def matches(self, automaton, words: list[str]) -> list[str]:
        """Entry of each match; of matches from one place the longest counts, and none inside an exception."""
        if not words or not len(automaton):
            return []
        # A word's last space is the first one of the next: whole words in a row are all found.
        line = " " + " ".join(words) + " "
        spared, longest = [], {}
        for end, (pattern, entry, exempt) in automaton.iter(line):
            start = end - len(pattern) + 1
            if exempt:
                spared.append((start, end))
            if entry is not None and (start not in longest or len(pattern) > longest[start][0]):
                longest[start] = (len(pattern), entry)
        found, reached, i = [], -1, 0
        spared.sort()
        for start in sorted(longest):
            while i < len(spared) and spared[i][0] <= start:
                reached = max(reached, spared[i][1])
                i += 1
            # The match is spared if a phrase that begins at or before it reaches past its first letter.
            if reached <= start + 1:
                found.append(longest[start][1])
        return found

    def hits(self, automaton, words: list[str]) -> tuple[float, int]:
        """Sum of the weights and number of the matches."""
        found = self.matches(automaton, words)
        return float(sum(self.entries[e] for e in found)), len(found)

    def density(self, total: float, n_words: int) -> float:
        return math.log1p(max(0.0, total) / max(1, n_words) ** self.length)

    def score(self, total: float, n_words: int) -> float:
        z = self.bias + self.slope * self.density(total, n_words)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _matched(lexicon: Lexicon):
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            totals, counts, lengths, scores = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                total, n = lexicon.hits(automaton, words)
                totals.append(total)
                counts.append(n)
                lengths.append(len(words))
                scores.append(lexicon.score(total, len(words)))
            yield pa.record_batch([batch.column("row"), pa.array(scores, pa.float64()), pa.array(totals, pa.float64()),
                                   pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())],
                                  names=["row", "score", "weight", "n_matches", "n_words"])

    return run


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with score, weight (of all matches), n_matches and n_words added.

    Names that are taken get underscores in front. Null and empty texts have no words and the score of no match. Whole
    texts are matched; a row needs memory for its own text only.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    packed = docs.select(row.alias("row"), col(text_col).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    scored = packed.mapInArrow(_matched(lexicon), f"row {kind}, score double, weight double, n_matches bigint, n_words bigint")
    names = ["score", "weight", "n_matches", "n_words"]
    return scored.select(*[F.col("row").getField(c).alias(c) for c in others], *[F.col(n).alias(fresh(docs, n)) for n in names])


def _terms(batches):
    """Arrow function: the possible entries of each labelled text."""
    for batch in batches:
        terms, ys = [], []
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
            own = terms_of(set(words_of(text.as_py() or "")))
            terms.extend(own)
            ys.extend([y] * len(own))
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array(ys, pa.int64())], names=["term", "y"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  sample: int = SAMPLE) -> Lexicon:
    """Learn entries, exceptions, weights and calibration from at most ``sample`` labelled rows; null labels are left out.

    Candidates are folded words, and beginnings that several words of a text share. Spark counts them by label; the
    driver sees only those with enough support and, for the labelled rows, which of them they hold. Entries are taken
    by greedy cover: most evidence in texts with label 1 that none matches yet. Words and pairs that an entry matches
    but that texts of label 0 hold as often become exceptions. Weights come from a logistic regression on the number
    of matches, none below zero. Texts that repeat count once, with the label of most of them, 0 if as many have
    either. With one label only there are no entries.
    """
    marked = labels.select(col(id_col).alias("label_id"), col(label_col).cast("bigint").alias("y")).where("y is not null")
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where(F.col("id").isNotNull())
    # Ids first, then the texts of those that are taken: at most `sample` rows are broadcast.
    chosen = own.select("id").join(marked, F.col("id") == F.col("label_id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = own.join(F.broadcast(chosen.select(F.col("id").alias("chosen"), "y").distinct()), F.col("id") == F.col("chosen"))
    rows = staged(rows.groupBy("text").agg((F.avg("y") > 0.5).cast("bigint").alias("y")), "labelled")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    if not n_bad or not n_good:
        share = (n_bad + 1) / (n_bad + n_good + 2)
        return Lexicon({}, bias=math.log(share / (1 - share)))
    counts = rows.mapInArrow(_terms, "term string, y bigint").groupBy("term").agg(
        F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    odds = (F.col("bad") + 0.5) / (n_bad + 1) / ((F.col("good") + 0.5) / (n_good + 1))
    strong = counts.where((F.col("bad") >= SUPPORT) & (odds > 4)).orderBy(
        F.desc(F.col("bad") * F.log(odds)), F.length("term"), "term").limit(8 * ENTRIES).select("term").collect()
    names = {r["term"]: k for k, r in enumerate(strong)}
    held = _in_order(rows.mapInArrow(_holding(names), "y bigint, held array<int>").toArrow())
    entries = _cover(list(names), held["held"].to_pylist(), held["y"].to_numpy())
    draft = Lexicon({e: 1.0 for e in entries})
    draft = Lexicon(draft.entries, _exceptions(rows, draft, n_bad, n_good))
    seen = rows.mapInArrow(_counted(draft), "y bigint, counts array<int>, n_words bigint").toArrow()
    seen = _in_order(seen)
    counted = np.array(seen["counts"].to_pylist(), dtype=float).reshape(len(seen), len(entries))
    ys, lengths = seen["y"].to_numpy().astype(float), seen["n_words"].to_numpy()
    draft = Lexicon(dict(zip(entries, _weights(counted, ys))), draft.exceptions)
    return calibrated(draft, counted @ np.array(list(draft.entries.values())), lengths, ys)


def _in_order(rows: pa.Table) -> pa.Table:
    """The rows of the labelled sample in one order whatever the partitions, as sums depend on it."""
    cells = list(zip(*(rows[c].to_pylist() for c in rows.column_names)))
    return rows.take(pa.array(sorted(range(len(cells)), key=cells.__getitem__), pa.int64()))


def _holding(names: dict):
    """Arrow function: label and candidates of each labelled text."""

    def run(batches):
        for batch in batches:
            held = [sorted(names[t] for t in terms_of(set(words_of(text.as_py() or ""))) if t in names) for text in batch.column("text")]
            yield pa.record_batch([batch.column("y"), pa.array(held, pa.list_(pa.int32()))], names=["y", "held"])

    return run


def _counted(lexicon: Lexicon):
    """Arrow function: label, number of matches of each entry and length of each labelled text."""

    def run(batches):
        automaton = lexicon.automaton()
        place = {e: k for k, e in enumerate(lexicon.entries)}
        for batch in batches:
            counts, lengths = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                row = [0] * len(place)
                for entry in lexicon.matches(automaton, words):
                    row[place[entry]] += 1
                counts.append(row)
                lengths.append(len(words))
            yield pa.record_batch([batch.column("y"), pa.array(counts, pa.list_(pa.int32())), pa.array(lengths, pa.int64())],
                                  names=["y", "counts", "n_words"])

    return run


def _cover(names: list, held, ys: np.ndarray) -> list:
    """Entries by greedy cover: the candidate with most evidence in texts of label 1 that no chosen one matches, until none is left.

    Whole words that very many texts of label 1 and nearly none of label 0 have are entries too, though the texts are covered.
    """
    members: dict = {}
    for i, own in enumerate(held):
        for k in own:
            members.setdefault(k, []).append(i)
    members = {k: np.array(v) for k, v in members.items()}
    bad = ys == 1
    n_bad, n_good = int(bad.sum()), int((~bad).sum())
    rate = {}
    for k, own in members.items():
        n = int(bad[own].sum())
        rate[k] = (math.log((n + 0.5) / (n_bad + 1)) - math.log((len(own) - n + 0.5) / (n_good + 1)), len(own) - n)
    plain = [k for k in sorted(rate) if not names[k].endswith("*") and rate[k][0] > 4.0
             and len(members[k]) - rate[k][1] >= max(4 * SUPPORT, COMMON * n_bad)]
    uncovered = bad.copy()
    entries: list = []
    while len(entries) < ENTRIES:
        best = (0.0, None)
        for k in sorted(members):
            open_bad = int(uncovered[members[k]].sum())
            if open_bad < SUPPORT:
                del members[k]
                continue
            odds, good = rate[k]
            if odds > 2.0 and open_bad * odds - good > best[0] + 1e-9:
                best = (open_bad * odds - good, k)
        if best[1] is None:
            break
        entries.append(names[best[1]])
        uncovered[members.pop(best[1])] = False
    stems = tuple(e[:-1] for e in entries if e.endswith("*"))
    more = [names[k] for k in plain if names[k] not in entries and not names[k].startswith(stems or ("\0",))]
    return (entries + more)[:ENTRIES]


def _weights(counts: np.ndarray, ys: np.ndarray, ridge: float = 1.0, steps: int = 600) -> list:
    """Logistic weights of the numbers of matches (up to 8), none below zero, by projected gradient steps."""
    if not counts.shape[1]:
        return []
    a = np.minimum(counts, 8)
    w, b = np.ones(a.shape[1]), -4.0
    rate = np.array([1.0 / (0.25 * (a[:, j] ** 2).sum() + ridge) for j in range(a.shape[1])])
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(a @ w + b, -30, 30))) - ys
        w = np.maximum(0.0, w - rate * (a.T @ error + ridge * w / 10))
        b -= 4.0 * error.mean()
    return [round(float(x), 4) for x in w]


def _exceptions(rows: DataFrame, lexicon: Lexicon, n_bad: int, n_good: int) -> tuple:
    """Words, and pairs with the one before or after, that the lexicon matches and texts of label 0 hold no less often."""

    def run(batches):
        stems = tuple(e[:-1] for e in lexicon.entries if e.endswith("*"))
        whole = {e for e in lexicon.entries if not e.endswith("*")}
        for batch in batches:
            out = {}
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = words_of(text.as_py() or "")
                own = set()
                for i, w in enumerate(words):
                    if w in whole or (stems and w.startswith(stems)):
                        own.add(w)
                        own.update(" ".join(words[a:a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
                for phrase in own:
                    bad, good = out.get(phrase, (0, 0))
                    out[phrase] = (bad + (y == 1), good + (y == 0))
            yield pa.record_batch([pa.array(list(out), pa.string()), pa.array([v[0] for v in out.values()], pa.int64()),
                                   pa.array([v[1] for v in out.values()], pa.int64())], names=["phrase", "bad", "good"])

    counts = rows.mapInArrow(run, "phrase string, bad bigint, good bigint").groupBy("phrase").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    fine = counts.where((F.col("good") >= 2) & (F.col("good") * n_bad >= F.col("bad") * n_good)).orderBy(F.desc("good"), "phrase").limit(EXCEPTIONS).collect()
    return tuple(r["phrase"] for r in fine)


def calibrated(lexicon: Lexicon, totals, lengths, ys) -> Lexicon:
    """Exponent of the length, slope and bias with the best log-likelihood (a little ridge keeps the slope finite)."""
    best = None
    for exponent in (0.125, 0.25, 0.5, 0.75, 1.0):
        x = np.log1p(np.maximum(0, totals) / np.maximum(1, lengths) ** exponent)
        spread = x.std() or 1.0
        a = np.stack([np.ones(len(x)), x / spread], axis=1)
        w = np.array([math.log((ys.mean() + 1e-6) / (1 - ys.mean() + 1e-6)), 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-6, 0.5]), a.T @ (ys - p) - np.array([0.0, 0.5]) * w)
            w = w + np.clip(step, -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.mean(ys * np.log(p) + (1 - ys) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = (loss, exponent, float(w[0]), float(w[1] / spread))
    return Lexicon(lexicon.entries, lexicon.exceptions, best[2], best[3], best[1])
