"""Scan of texts by a table of rules: a pattern is only tried on texts that hold the word it needs."""

from __future__ import annotations

import re
from re import _parser as grammar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.text import folded
from corpuscope.operators.matching import Terms
from corpuscope.operators.quality import PREFIX

# Rules that one pass over the texts tries.
RULES_AT_ONCE = 1 << 14
# Bytes of texts whose pieces are looked up together; a longer text is alone.
AT_ONCE_BYTES = 1 << 21

RULE = ["rule_id", "kind", "severity", "message"]
TRIED = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in [*RULE, "pattern", "word"]]))


def required_word(pattern: str, ignore_case: bool) -> str:
    """The longest literal that every match of a pattern holds; empty where none is sure.

    Only characters outside of classes, choices, groups and repeats count, and where case is ignored only ASCII ones, in lower
    case. A pattern that Python's grammar does not know, or that sets flags, needs nothing.
    """
    try:
        parsed = grammar.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if parsed.state.flags & ~re.UNICODE.value:
        return ""
    runs = [""]
    for op, value in parsed:
        literal = str(op) == "LITERAL" and not (ignore_case and value > 127)
        if literal:
            runs[-1] += chr(value)
        elif runs[-1]:
            runs.append("")
    longest = max(runs, key=len)
    return longest.lower() if ignore_case else longest


def _tried(sent, ignore_case: bool):
    """Column function: the rules whose word's rarest piece stands in a text."""
    # Structures as Arrow makes them; the types of Spark are only needed on the driver.
    kind = pa.list_(pa.struct([(c, pa.string()) for c in [*RULE, "pattern", "word"]]))
    terms: list[Terms] = []

    def part_found(texts: pa.Array) -> pa.Array:
        rules = sent.value[ignore_case]
        found: list = [[] if ok else None for ok in texts.is_valid().to_pylist()]
        for rule, rows in terms[0].candidates(texts):
            for row in rows.tolist():
                found[row].append(rules[rule])
        return pa.array(found, kind)

    def run(texts: pa.Array) -> pa.Array:
        if not terms:
            terms.append(Terms([r["word"] for r in sent.value[ignore_case]], True))
        part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64) // AT_ONCE_BYTES
        begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        parts = [part_found(texts.slice(b, e - b)) for b, e in zip(begins, [*begins[1:], len(texts)])]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, TRIED)


def _matching(tried: Column, source: str, text: str, flags: str) -> Column:
    return F.filter(tried, lambda r: F.contains(F.col(source), r.word) & F.rlike(F.col(text), F.concat(F.lit(flags), r.pattern)))


def scan_rule_table(docs: DataFrame, rules: DataFrame, text: str, keys) -> DataFrame:
    """One finding per text and rule that matches: ``*keys, rule_id, kind, severity, message``.

    ``rules``: rule_id, kind, severity, pattern (Java's grammar), message, word, ignore_case; ``word`` is a literal that every
    match holds, lower case where case is ignored, and found from the pattern where it is NULL. Rules without a pattern
    match nothing, repeated rules repeat their findings, NULL texts have none. The kind's prefix goes before a message.

    The rules are sent to the tasks, ``RULES_AT_ONCE`` in one pass over the texts; neither texts nor findings are shuffled or
    joined. In a batch of texts a rule is looked up by the rarest piece of its word; only then the JVM tries the word and
    then the pattern. Rules without a sure word are tried on every text. A pattern that is not valid fails the query.
    """
    wanted = rules.where("pattern is not null").select(*RULE, "pattern", "word", F.coalesce("ignore_case", F.lit(True)).alias("ignore_case"))
    passes = max(1, -(-wanted.count() // RULES_AT_ONCE))
    texts = docs.select(*keys, F.col(text).alias("__text"), folded(text).alias("__folded"))
    found = None
    for i in range(passes):
        own: dict[bool, list[dict]] = {True: [], False: []}
        for row in wanted.where(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(passes)) == i).collect():
            rule = row.asDict()
            any_case = rule.pop("ignore_case")
            word = rule["word"] if rule["word"] is not None else required_word(rule["pattern"], any_case)
            own[any_case].append(rule | {"word": word, "message": PREFIX.get(rule["kind"], "") + (rule["message"] or "")})
        sent = docs.sparkSession.sparkContext.broadcast(own)
        hits = [F.array().cast(TRIED)]
        if own[True]:
            hits.append(_matching(_tried(sent, True)("__folded"), "__folded", "__text", "(?iUd)"))
        if own[False]:
            hits.append(_matching(_tried(sent, False)("__text"), "__text", "__text", "(?Ud)"))
        part = texts.where("__text is not null").select(*keys, F.explode(F.concat(*hits)).alias("r"))
        part = part.select(*keys, *[F.col(f"r.{c}") for c in RULE])
        found = part if found is None else found.unionByName(part)
    return found
