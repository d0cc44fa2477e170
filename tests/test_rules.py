import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from corpuscope.operators import rules as rules_module
from corpuscope.operators.quality import PERFORMANCE, PREFIX, SECURITY, scan_rules
from corpuscope.operators.rules import required_word, scan_rule_table
from corpuscope.plans.recheck import check_changed, kept_findings
from corpuscope.plans.validation import all_findings, check_files
from corpuscope.session import staged_parts
from tests.conftest import plan, rows
from tests.test_quality import CODE, frame, texts
from workload.tables import source_files

SCHEMA = "rule_id string, kind string, severity string, pattern string, message string, word string, ignore_case boolean"


@pytest.mark.parametrize("pattern, any_case, word", [
    (r"eval\s*\(", True, "eval"), (r"os\.system\s*\(", True, "os.system"), ("a|b", True, ""), ("abc|abd", False, "ab"), ("(abc)+", True, ""),
    ("x?yz{2}", False, "y"), ("KeyÄ", True, "key"), ("KeyÄ", False, "KeyÄ"), ("(?i)abc", False, ""), (r"\p{L}x", True, ""), ("", True, ""),
    (r"\Qa.b\E", True, ""), ("[ab]cd", True, "cd"), (r"^\btoken$", True, "token")])
def test_required_word(pattern, any_case, word):
    assert required_word(pattern, any_case) == word


def as_rows(spark, rules, words=True):
    return spark.createDataFrame(
        [(r.rule_id, r.kind, r.severity, r.pattern, r.message, r.word if words else None, r.ignore_case) for r in rules], SCHEMA)


@pytest.mark.parametrize("words", [True, False])
def test_table_equals_columns(spark, words):
    got = scan_rule_table(frame(spark), as_rows(spark, SECURITY + PERFORMANCE, words), "text", ["id"])
    want = scan_rules(frame(spark), SECURITY + PERFORMANCE, "text", ["id"])
    assert rows(got, *want.columns) == rows(want) and want.count() > 50
    text = plan(got)
    assert "Join" not in text and "Exchange" not in text


def test_many_rules_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rules = [(f"r{i}", "style", "low", rf"{a}\s+{b}" if i % 3 else f"{a}[{b}]|{b}{a}", "m", None, bool(i % 2))
             for i, (a, b) in enumerate(zip(words, reversed(words)))]
    rules += [("none", "style", "low", None, "m", None, True), ("all", "style", "low", "", None, None, None), rules[0]]
    table = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame([*table, (99, None)], "id int, text string")
    want = sorted(((i, r[0]) for i, t in table for r in rules
                   if r[3] is not None and re.search(r[3], t, re.I if r[6] in (True, None) else 0)), key=repr)
    for at_once in (1 << 14, 100):
        monkeypatch.setattr(rules_module, "RULES_AT_ONCE", at_once)
        got = scan_rule_table(docs, spark.createDataFrame(rules, SCHEMA), "text", ["id"])
        assert rows(got, "id", "rule_id") == want
    assert len(want) > 500 and "style" not in PREFIX
    assert scan_rule_table(docs, spark.createDataFrame([], SCHEMA), "text", ["id"]).count() == 0
    assert scan_rule_table(docs.limit(0), spark.createDataFrame(rules, SCHEMA), "text", ["id"]).count() == 0


def test_only_new_contents_are_checked(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = [*CODE, ("null.py", None), ("copy.py", CODE[0][1]), (None, "eval(1)"), ("empty.py", "")]
    second = [*[(f, t) for f, t in first if f != "null.py"], ("new.py", "exec(2)"), ("new2.py", "exec(2)"), ("null2.py", None)]
    columns = ["file_path", "rule_id", "kind", "severity", "message"]
    known = None
    for n, files in enumerate((first, second, second)):
        df = spark.createDataFrame(files, "file_path string, content string").repartition(3)
        got = check_changed(df, path)
        assert rows(got, *columns) == rows(check_files(df), *columns)
        contents = {t for f in (first, second)[:n + 1] for _, t in f if t is not None}
        assert kept_findings(spark, path).count() == len(contents)
        known = {r.file_path: r.known for r in got.collect()}
    assert known["new.py"] and known["copy.py"] and not known["null2.py"]
    # Other rules are other findings.
    df = spark.createDataFrame(second, "file_path string, content string")
    assert rows(check_changed(df, path, tuple(SECURITY), lint=False), *columns) == rows(check_files(df, tuple(SECURITY), lint=False), *columns)


def test_known_is_of_earlier_runs(spark, tmp_path):
    path = str(tmp_path / "kept")
    one = spark.createDataFrame([("a", "x = 1"), ("b", "y = 1")], "file_path string, content string")
    two = spark.createDataFrame([("a", "x = 1"), ("b", "y = 2"), ("a", "x = 1")], "file_path string, content string")
    assert {r.known for r in check_changed(one, path).collect()} == {False}
    assert rows(check_changed(two, path), "file_path", "known") == [("a", True), ("a", True), ("b", False)]
    assert check_changed(one.limit(0), path).count() == 0


def test_texts_of_known_contents_do_not_move(spark, tmp_path):
    one = spark.createDataFrame([("a", "x = 1")], "file_path string, content string")
    text = plan(check_changed(one, str(tmp_path / "kept")))
    assert "ArrowEvalPython" not in text


def test_passes_find_the_same(spark, tmp_path):
    """Passes share the contents out: what is found and kept is that of one pass, in whatever number a later run works."""
    files = [*CODE, ("null.py", None), ("copy.py", CODE[0][1]), (None, "eval(1)"), *[(f"{i}.py", f"exec({i % 40})\n_a = '\\\\ \"é\"'\n") for i in range(60)]]
    df = spark.createDataFrame(files, "digest string, content string")
    want = rows(check_files(df, keys=["digest"]))
    contents = sorted({hashlib.sha256(t.encode()).digest() for _, t in files if t is not None})
    path = str(tmp_path / "kept")
    for passes, known in ((3, False), (2, True), (0, True)):
        got = check_changed(df, path, keys=["digest"], passes=passes)
        assert rows(got, "digest", "rule_id", "kind", "severity", "message") == want
        assert sorted(bytes(r.digest) for r in kept_findings(spark, path).collect()) == contents
        assert {r.known for r in got.where("digest <> 'src/e.py' and digest <> 'null.py'").collect()} == {known}


def test_shuffles_are_narrow(spark, tmp_path):
    """Texts are dealt without their findings, digests are bytes, and a rechecked table is made once and read."""
    df = spark.createDataFrame([("a", "x = 1")], "file_path string, content string")
    text = plan(all_findings(df, ["file_path"]))
    assert text.index("RLIKE") < text.index("Exchange")
    assert dict(kept_findings(spark, str(tmp_path / "none")).dtypes)["digest"] == "binary"
    text = plan(check_changed(df, str(tmp_path / "kept")))
    assert "json" in text.lower() and "RLIKE" not in text
    text = plan(queries()["recheck_files"](spark, "/root/testdata/sf0.001"))
    assert "l_orderkey" not in text and "sources-" in text


def test_parts_leave_no_shuffles(spark):
    """A table that is made part by part has the rows of the whole, and shuffle files of a part go before the next."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    seen = []

    def left():
        return manager.getAllFiles().mkString(" ").count("/shuffle_")

    def parts():
        for part in range(4):
            until = time.time() + 20
            while part and left() > seen[0] and time.time() < until:
                time.sleep(0.1)
            seen.append(left())
            yield spark.range(1000).where(f"id % 4 = {part}").repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).count()

    table = staged_parts(parts(), "test")
    assert max(seen) == seen[0] and table.agg(F.sum("count")).first()[0] == 1000
    whole, split = source_files(spark, "/root/testdata/sf0.001"), [source_files(spark, "/root/testdata/sf0.001", i, 3) for i in range(3)]
    assert rows(whole) == rows(split[0].union(split[1]).union(split[2])) and all(s.limit(1).count() for s in split)
