
import ast
import sys
import random
import re

from pyspark.sql import functions as F

from corpuscope.operators.quality import (PERFORMANCE, SECURITY, code_metrics, complexity, route_findings, scan_rules, top_issues,
                                          validate, validate_checked, validation_summary)
from corpuscope.operators.symbols import _listed, import_edges, lint_findings, symbol_counts, symbol_index, syntax_nodes
from corpuscope.operators.edits import STEPS, delta_counts
from corpuscope.plans import validation
from corpuscope.plans.validation import check_files, record_passed, run_changes
from corpuscope.session import staged
from corpuscope.sources.ledger import read_ledger
from tests.conftest import plan, rows

PIECES = ["EVAL (", "exec(", "input\u00a0(", "subprocess.run", "os.system (", "pickle.load(", "__import__(", "password = 'x'", "paſſword='y'",
          "API_KEY=\"k\"", "tokeN =\t'", "\u212aey", "İnput (", "for i in range(len(x))", "x += \n str", "a += b str", "l.append(v for v", "global  z",
          "secret='a\nb'", "\r\n", "\x0b", "\u2028", "#c", "  # d", "\n\n", "def f", "class X", "import a", "from b", "if x", "elif y", "else:", " "]


def texts(n=150):
    rng = random.Random(3)
    return ["", "\n", "a\n", "a\n\n", "\r\n\r", "x\x1cy\x85"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id bigint, text string")


def test_rules_match_python(spark):
    got = {(r.id, r.rule_id) for r in scan_rules(frame(spark), SECURITY + PERFORMANCE, "text", ["id"]).collect()}
    want = {
        (i, rule.rule_id)
        for i, t in enumerate(texts())
        for rule in SECURITY + PERFORMANCE
        if re.search(rule.pattern, t, re.I if rule.ignore_case else 0)
    }
    assert got == want and len({r for _, r in want}) > 10


def test_rules_are_one_scan(spark):
    text = plan(scan_rules(frame(spark), SECURITY, "text", ["id"]))
    assert "Join" not in text and "Exchange" not in text


def test_metrics_match_python(spark):
    got = {r.id: r for r in code_metrics(frame(spark), "text", ["id"]).collect()}
    scores = {r.id: r for r in complexity(frame(spark), "text", ["id"]).collect()}
    for i, t in enumerate(texts()):
        lines = t.splitlines()
        assert got[i].lines_of_code == len(lines), repr(t)
        assert got[i].blank_lines == sum(not x.strip() for x in lines), repr(t)
        assert got[i].comment_lines == sum(x.strip().startswith("#") for x in lines), repr(t)
        assert got[i].imports_count == t.count("import ") + t.count("from ")
        score = sum(t.count(k) for k in ["if ", "elif ", "else:", "for ", "while ", "try:", "except:", "with "])
        assert scores[i].complexity_score == score
        assert scores[i].complexity_estimate == ("high" if score > 20 else "medium" if score > 10 else "low")


LONG = "def long_one():\n" + "    x = 1\n" * 60
VERY = "def very_long():\n    'doc'\n" + "    x = 1\n" * 120
CODE = [
    ("src/a.py", "import os, util.b\nfrom b import c\n_x = 1\n__y = 2\ntry:\n    pass\nexcept:\n    pass\nclass K:\n    'doc'\n    def m(self, a): pass\n"),
    ("src/b.py", LONG),
    ("src/c.py", VERY),
    ("src/d.py", "def broken(:\n"),
    ("src/e.py", None),
    ("x/b.py", "from . import a\npassword = 'x'\nfor i in range(len(x)): pass\n"),
]


def test_lint(spark):
    files = spark.createDataFrame(CODE, "file_path string, content string")
    got = {(r.file_path, r.rule_id, r.severity, r.line) for r in lint_findings(files).collect()}
    assert got == {
        ("src/a.py", "unused_variable", "suggestion", 3), ("src/a.py", "bare_except", "warning", 7),
        ("src/a.py", "missing_docstring", "warning", 11),
        ("src/b.py", "function_length", "warning", 1), ("src/b.py", "missing_docstring", "warning", 1),
        ("src/c.py", "function_length", "error", 1), ("src/d.py", "syntax_error", "error", 0),
    }


def test_rules_over_nodes(spark):
    """Parts of statements where a rule could look at the wrong node."""
    text = (
        "try:\n    def f(a, /, b, *c, d=lambda q: 1, **e):\n        'doc'\nexcept (A, B):\n    _a = _b = __c = x._d = 1\n"
        "finally:\n    pass\nclass K:\n    x = 'no doc'\n    'late'\n    async def g(self): pass\n"
        "def h():\n    b'bytes'\n    def inner(): 'doc'\nmatch x:\n    case 1:\n        try: pass\n        except: _z: int = 1\n"
        "(_t, _u) = 1, 2\nfrom .. import p as q, r\nimport s.t as u\n")
    files = spark.createDataFrame([("a", text), ("a", "def k(): pass"), ("n", None), ("e", ""), ("nul", "x\0"), ("deep", "(" * 5000)],
                                  "file_path string, content string")
    found = lint_findings(files).orderBy("file_path", "pos").collect()
    assert sorted((r.rule_id, r.line, r.message.split(": ", 1)[1]) for r in found if r.file_path == "a") == sorted([
        ("unused_variable", 5, "Variable _a appears unused"), ("unused_variable", 5, "Variable _b appears unused"),
        ("missing_docstring", 8, "ClassDef 'K' missing docstring"), ("missing_docstring", 12, "FunctionDef 'h' missing docstring"),
        ("bare_except", 18, "Bare except clause detected"), ("missing_docstring", 1, "FunctionDef 'k' missing docstring")])
    assert sorted(r.file_path for r in found if r.rule_id == "syntax_error") == ["deep", "nul"]
    symbols = {(r.kind, r.name, r.line, tuple(r.args or ())) for r in symbol_index(files).collect()}
    assert symbols == {
        ("function", "f", 2, ("b",)), ("variable", "_a", 5, ()), ("variable", "_b", 5, ()), ("variable", "__c", 5, ()), ("class", "K", 8, ()),
        ("variable", "x", 9, ()), ("function", "h", 12, ()), ("function", "inner", 14, ()), ("import", ".p", 20, ()), ("import", ".r", 20, ()),
        ("import", "s.t", 21, ()), ("function", "k", 1, ())}


def test_node_rows(spark):
    text = "def f(a):\n    return a + g(1)\n"
    files = spark.createDataFrame([("a", text), ("b", "x"), ("empty", ""), ("bad", "def"), ("n", None)], "file_path string, content string")
    nodes = syntax_nodes(files)
    want = {path: [type(n).__name__ for n in ast.walk(ast.parse(t))] for path, t in (("a", text), ("b", "x"), ("empty", ""))}
    got = {}
    for r in nodes.orderBy("file_path", "node").collect():
        got.setdefault(r.file_path, []).append(r.kind)
    assert got == want
    parents = nodes.select("file_path", F.col("node").alias("parent"), F.col("kind").alias("of"), "first", "children")
    met = nodes.drop("first", "children").join(parents, ["file_path", "parent"])
    assert met.where("node < first or node >= first + children").count() == 0
    assert rows(met.where("name is not null"), "of", "field", "name") == [
        ("BinOp", "left", "a"), ("Call", "args", "int"), ("Call", "func", "g"), ("Expr", "value", "x"), ("Module", "body", "f"), ("arguments", "args", "a")]


def test_symbols_and_edges(spark):
    files = spark.createDataFrame(CODE, "file_path string, content string")
    symbols = symbol_index(files)
    a = {(r.kind, r.name) for r in symbols.where("file_path = 'src/a.py'").collect()}
    assert a == {("import", "os"), ("import", "util.b"), ("import", "b.c"), ("variable", "_x"), ("variable", "__y"), ("class", "K"), ("function", "m")}
    assert symbols.where("name = 'm'").first().args == ["self", "a"]
    assert symbol_counts(symbols).where("kind = 'import'").first().symbols == 4
    assert rows(import_edges(symbols, files)) == [("src/a.py", "b", "src/b.py", 1), ("x/b.py", "a", "src/a.py", 1)]


def test_edges_by_module_path(spark):
    files = spark.createDataFrame([
        ("src/pkg/mod.py", "x = 1"), ("src/pkg/__init__.py", ""), ("lib/util.py", ""), ("src/util.py", ""), ("app/util.py", "import pkg"),
        ("app/main.py", "from pkg.mod import f\nimport util\nimport pkg.mod\nimport os\nfrom pkg import mod"),
        ("src/run.py", "import util\nimport src.pkg.mod as m"), ("top.py", "import util\nimport lib.util")], "file_path string, content string")
    assert rows(import_edges(symbol_index(files), files)) == [
        ("app/main.py", "pkg.mod", "src/pkg/mod.py", 1), ("app/main.py", "util", "app/util.py", 1), ("app/util.py", "pkg", "src/pkg/__init__.py", 1),
        ("src/run.py", "src.pkg.mod", "src/pkg/mod.py", 1), ("src/run.py", "util", "src/util.py", 1),
        ("top.py", "lib.util", "lib/util.py", 1), ("top.py", "util", None, 3)]


def test_one_read_equals_two_tables(spark):
    files, found = findings(spark)
    all_files = spark.createDataFrame([*CODE, ("null.py", None)], "file_path string, content string")
    checked = check_files(all_files)
    got = rows(checked.where("kind is not null").select("file_path", "rule_id", "kind", "severity", "message"))
    assert got == rows(found.select("file_path", "rule_id", "kind", "severity", "message"))
    assert sorted(r.file_path for r in checked.where("kind is null").collect()) == sorted(f for f, _ in [*CODE, ("null.py", None)])
    for strict in (False, True):
        want = rows(validate(all_files, found, ["file_path"], strict=strict))
        assert rows(validate_checked(checked, ["file_path"], strict=strict)) == want
    text = plan(validate_checked(checked, ["file_path"]))
    # Only the texts go to Python, once, for the parse; findings of the rules stay in the JVM.
    assert text.count("ArrowEvalPython") == 1 and "MapInArrow" not in text and "Join" not in text and "Union" not in text


def test_change_plan_to_ledger(spark, tmp_path):
    files = spark.createDataFrame([("r1", "a", "x = 1"), ("r1", "b", "eval(1)"), ("r2", "c", "eval(2)"), ("r3", "d", "y"), ("r4", "e", "z")],
                                  "run_id string, file_path string, content string")
    edits = spark.createDataFrame([("b", 0, "modify", 0, "eval(1)", "safe"), ("c", 0, "add", 1, None, "import os"), ("d", 0, "modify", 0, "none", "n"),
                                   ("lost", 0, "add", 1, None, "n")],
                                  "file_path string, seq int, action string, line_number int, old_code string, new_code string")
    runs = run_changes(files, edits, strict=True, lint=False)
    got = {r.run_id: (r.files_edited, r.files_not_edited, r.total_errors, r.passed) for r in runs.collect()}
    assert got == {"r1": (1, 0, 0, True), "r2": (1, 0, 1, False), "r3": (0, 1, None, False), "r4": (0, 0, 0, True)}
    record_passed(runs, str(tmp_path / "l"), F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.user_id for r in read_ledger(spark, str(tmp_path / "l")).collect()) == ["r1", "r4"]


def test_change_plan_makes_every_edit_once(spark, monkeypatch):
    """No edit is made twice, no text goes to Python for short lists, and the outcome of a run is read, not found again."""
    plans = {}
    monkeypatch.setattr(validation, "staged", lambda df, purpose: plans.setdefault(purpose, plan(df)) and staged(df, purpose))
    files = spark.createDataFrame([("r", "a", "a0"), ("r", "b", "b"), ("s", None, "n")], "run_id string, file_path string, content string")
    for n in (STEPS, STEPS + 1):
        plans.clear()
        edits = spark.range(n).selectExpr("'a' as file_path", "id as seq", "'modify' as action", "0 as line_number",
                                          "concat('a', id) as old_code", "concat('a', id + 1) as new_code")
        lost = edits.limit(1).select(F.lit(None).cast("string").alias("file_path"), *edits.columns[1:])
        runs = run_changes(files, edits.unionByName(lost), lint=False)
        assert rows(runs, "run_id", "files_edited", "files_not_edited", "total_files") == [("r", 1, 0, 2), ("s", 0, 0, 1)]
        assert plans["edited"].count("aggregate(") == 1 and plans["edited"].count("ArrowEvalPython") == (n > STEPS)
        assert "RLIKE" not in plan(runs) and "Join" not in plan(runs)


def findings(spark):
    files = spark.createDataFrame(CODE, "file_path string, content string").where("content is not null")
    scanned = scan_rules(files, SECURITY + PERFORMANCE, "content", ["file_path"])
    return files, scanned.unionByName(lint_findings(files).select(scanned.columns))


def test_validation(spark):
    files, found = findings(spark)
    normal = {r.file_path: r for r in validate(files, found, ["file_path"]).collect()}
    strict = {r.file_path: r for r in validate(files, found, ["file_path"], strict=True, skip_warnings=True).collect()}
    assert normal["x/b.py"].warnings == 1 and normal["x/b.py"].suggestions == 1 and normal["x/b.py"].validation_passed
    assert strict["x/b.py"].errors == 1 and not strict["x/b.py"].validation_passed and strict["src/b.py"].reported_warnings == 0
    assert not strict["src/b.py"].validation_passed and normal["src/b.py"].validation_passed
    assert not normal["src/d.py"].syntax_valid and normal["src/d.py"].errors == 1
    total = validation_summary(validate(files, found, ["file_path"])).first()
    assert (total.total_files, total.files_with_errors, total.total_errors) == (5, 2, 2)
    assert total.overall_quality_score == 100 - 20 - 2 * total.total_warnings
    assert total.overall_status == "failed" and total.legacy_status == "passed"


def test_score_is_clamped(spark):
    df = spark.createDataFrame([("a", 12, 0, 0, False)], "f string, errors bigint, warnings bigint, suggestions bigint, validation_passed boolean")
    assert validation_summary(df).first().overall_quality_score == 0.0


def test_top_issues(spark):
    data = [("r1", f"f{i}", "security", "high") for i in range(9)] + [("r1", "g", "static", "warning"), ("r2", "h", "static", "warning")]
    found = spark.createDataFrame(data, "run string, file_path string, kind string, severity string")
    routed = route_findings(found, strict=True)
    top = top_issues(routed, ["run"], ["file_path"])
    assert top.where("level = 'error'").count() == 5 and top.where("level = 'warning'").count() == 2
    assert [r.run for r in top_issues(routed, ["run"], ["file_path"], warnings_if_clean=True).where("level = 'warning'").collect()] == ["r2"]


def test_broken_file_keeps_only_its_syntax_finding(spark):
    found = spark.createDataFrame([("a", "syntax", "error"), ("a", "security", "high"), ("b", "security", "high")],
                                  "file_path string, kind string, severity string")
    assert rows(route_findings(found)) == [("a", "syntax", "error", "error"), ("b", "security", "high", "warning")]


def test_delta_counts_on_breaks(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\n", "a\nb\nc"), (2, None, "x"), (3, "", "")], "k int, old string, new string")
    assert rows(delta_counts(df, "k", "old", "new")) == [(1, 1, 2, 1), (2, 1, 0, 0)]
    assert df.where(F.col("old") == "").count() == 1


def test_listing_calls_little():
    """What is listed of a class of nodes is looked up once, not asked of every node."""
    text = "".join(f"def f{i}(a, b):\n    x = a\n    import os\n" for i in range(50))
    nodes, calls = len(list(_listed(text, False))), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        list(_listed(text, False))
    finally:
        sys.setprofile(None)
    assert nodes == 1 + 50 * 8 and len(calls) < 16 * nodes
