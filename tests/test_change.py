import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import change, sweep
from corpuscope.operators.edits import apply_edits, edit_eligible, line_delta
from corpuscope.operators.requests import classify_request, extract_files, mentions, missing_in_context, missing_mentions
from corpuscope.operators.topk import positions
from tests.conftest import plan, rows

REQUESTS = [
    ("r1", "Migrate a.py and 'b c.py' to PySpark, all files, in the d.py now"),
    ("r2", "Add urgent tests; create helper-x.py"),
    ("r3", "FIX the Bug in \"my-file.py\" and foo.pyx, BIG.PY"),
    ("r4", "improve speed"),
    ("r5", ""),
    ("r6", None),
]


def requests(spark):
    return spark.createDataFrame(REQUESTS, "run_id string, text string")


def test_classes_and_mentions(spark):
    got = dict(rows(classify_request(requests(spark), "text"), "run_id", "query_type"))
    assert got == {"r1": "migration", "r2": "feature_addition", "r3": "bug_fix", "r4": "optimization", "r5": "general", "r6": "general"}
    first = mentions(requests(spark), "text").where("run_id = 'r1'").first()
    assert first.technologies_mentioned == ["pyspark", "spark"] and first.scope_indicators == ["all files"] and first.action_words == ["migrate"]


FILES = {"r1": {"a.py", "c.py", "d.py"}, "r2": {"x.py"}, "r3": {"my-file.py", "file.py"}}


def test_files(spark):
    got = {}
    for r in extract_files(requests(spark), "text", ["run_id"]).collect():
        got.setdefault(r.run_id, set()).add(r.file_name)
    for run, text in REQUESTS:
        assert got.get(run, set()) == FILES.get(run, set()), text
    planned = spark.createDataFrame([("r1", "src/a.py"), ("r3", "x/my-file.py/")], "run_id string, file_path string")
    missing = rows(missing_mentions(extract_files(requests(spark), "text", ["run_id"]), planned, ["run_id"]))
    assert ("r1", "d.py") in missing and ("r1", "a.py") not in missing and ("r3", "my-file.py") not in missing
    context = requests(spark).withColumn("context", F.lit("Uses A.PY and d.py"))
    assert ("r1", "a.py") not in rows(missing_in_context(context, "text", "context", ["run_id"]))


PLANS = [
    ("r1", 0, "src/config.py", "high", ["import pyspark"]), ("r1", 1, "src/zeta.py", "high", []), ("r1", 2, "src/load.py", "medium", None),
    ("r1", 3, "lib/config.py", "odd", None), ("r1", 4, "src/config.py", "low", None), ("r1", 5, "src/pyspark_job.py", None, ["x"]),
    ("r2", 0, "q.py", "low", None), ("r4", 0, "w.py", "high", ["numpy"]),
]
MODS = [
    ("r1", 0, "add", None, "import pyspark", "migrate as the user asked", None),
    ("r1", 0, "delete", "x", None, "convert", ""), ("r1", 1, "modify", "y", "z", None, "other.py"), ("r4", 0, "modify", "", "numpy", "Improve", None),
]


def frames(spark):
    plans = spark.createDataFrame(PLANS, "run_id string, pos bigint, file_path string, priority string, new_dependencies array<string>").withColumns(
        {"modification_type": F.lit(None).cast("string"), "needs_modification": F.lit(None).cast("boolean")})
    mods = spark.createDataFrame(MODS, "run_id string, pos bigint, action string, old_code string, new_code string, explanation string, file_path string")
    return plans, mods


# Worked out by hand: hits / checks per planned file.
ALIGNMENT = {
    ("r1", 0): 4.3 / 5,  # pyspark, spark, package, user, migrate of two technologies, package, intent, one action
    ("r1", 1): 0.0,
    ("r1", 2): 0.5,
    ("r1", 3): 0.5,
    ("r1", 4): 0.5,
    ("r1", 5): 0.0,
    ("r2", 0): 0.5,
    ("r4", 0): 0.0,
}


def test_alignment(spark):
    plans, mods = frames(spark)
    got = change.alignment(plans, mods, requests(spark)).collect()
    assert {(r.run_id, r.pos): round(r.user_alignment_score, 12) for r in got} == {k: round(v, 12) for k, v in ALIGNMENT.items()}
    assert {(r.run_id, r.pos): r.n_modifications for r in got if r.n_modifications} == {("r1", 0): 2, ("r1", 1): 1, ("r4", 0): 1}


def test_execution_order(spark):
    # The first long words of r1 are migrate, a.py and c.py'; "a.py" is in zeta.py too.
    data = [
        ("r1", 0, "s/zeta.py", "high", 0.2), ("r1", 1, "s/write_x.py", "high", 0.1), ("r1", 2, "s/my_a.py", "high", 0.0),
        ("r1", 3, "s/do_migrate.py", "high", 0.0), ("r1", 4, "s/eta.py", "high", 0.9), ("r1", 5, "s/config.py", "low", 1.0),
        ("r1", 6, "s/Load.py", "medium", 0.5), ("r1", 7, "t/load.py", "medium", 0.6), ("r1", 8, "s/odd.py", "odd", 1.0),
        ("r1", 9, "s/zeta.py", "low", 1.0), ("r1", 10, "s/beta.py", "high", 0.2), ("r2", 0, "x.py", "low", 0.5),
    ]
    entries = spark.createDataFrame(data, "run_id string, pos bigint, file_path string, priority string, user_alignment_score double")
    got = change.execution_order(entries, requests(spark)).orderBy("run_id", "execution_position").collect()
    assert [r.file_path for r in got if r.run_id == "r1"] == [
        "s/do_migrate.py", "s/eta.py", "s/zeta.py", "s/beta.py", "s/my_a.py", "s/write_x.py", "t/load.py", "s/Load.py", "s/config.py"]
    assert [r.execution_position for r in got] == [*range(1, 10), 1]
    assert [r.priority for r in got if r.run_id == "r2"] == ["low"]


def test_positions_match_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), "id", F.floor(F.col("id") / 100).alias("c"))
    got = positions(df, ["k"], ["c"], ["id"]).collect()
    for k in (True, False):
        assert [r.position for r in sorted((r for r in got if r.k == k), key=lambda r: r.id)] == list(range(1, sum(r.k == k for r in got) + 1))


def test_positions_with_nulls(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 1, 2), ("a", None, 3), ("a", 1, 4), ("a", None, 0)], "k string, c int, id int")
    got = {r.id: r.position for r in positions(df, ["k"], ["c"], ["id"]).collect()}
    assert got == {1: 1, 2: 2, 0: 1, 3: 2, 4: 3}


def test_roll_ups(spark):
    plans, mods = frames(spark)
    entries = change.plan_entries(change.alignment(plans, mods, requests(spark)))
    risk = {}
    for r in change.risks(entries, requests(spark)).orderBy("run_id", "risk_no").collect():
        risk.setdefault(r.run_id, []).append(r.risk)
    assert risk["r1"][0] == "Migration project detected - thorough testing recommended"
    assert "Project-wide changes requested - staged rollout recommended" in risk["r1"] and "r5" not in risk
    assert {r.run_id: r.estimated_complexity for r in change.plan_complexity(entries).collect()}["r1"] == "medium"
    rolled = {r.run_id: r for r in change.plan_rollup(entries, requests(spark)).collect()}
    assert rolled["r5"].overall_alignment_score == 0.0 and rolled["r5"].n_files == 0 and rolled["r1"].n_files == 6
    assert entries.where("file_path = 'src/pyspark_job.py'").first().priority == "medium"


def test_roles(spark):
    df = spark.createDataFrame([("a/b/App_Config.py",), ("helper.py/",), ("",), ("x/main.py",), ("d/test_data.py",), ("preload.py",)], "p string")
    got = {r.p: (r.file_type, r.dependency_hint) for r in change.file_roles(df, "p").collect()}
    assert got["a/b/App_Config.py"] == ("configuration", "App_Config.py - configuration dependency")
    assert got["helper.py/"] == ("utility", None) and got[""] == ("general", None)
    assert got["d/test_data.py"][0] == "test" and got["preload.py"] == ("data_processing", "preload.py - data loading dependency")


def test_targets(spark):
    schema = "run_id string, pos bigint, priority string, depends_on array<string>, affects array<string>, imports_from array<string>, imported_by array<string>, dependency_reason string"
    df = spark.createDataFrame([("r", 0, "low", None, None, None, None, None), ("r", 1, "odd", ["a"], None, [], None, None),
                                ("r", 2, "high", [], [], [], [], ""), ("r", 3, None, None, None, None, None, "why")], schema)
    got = {r.pos: r for r in change.prepare_targets(df).collect()}
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1].target_position)] == [2, 3, 0, 1]
    assert got[0].cross_file_dependencies is None and got[2].cross_file_dependencies is None
    assert got[1].cross_file_dependencies.affects == [] and got[3].cross_file_dependencies.dependency_reason == "why"


def test_grouping_and_generation(spark):
    plans, mods = frames(spark)
    grouped = change.group_mods(mods, plans)
    assert rows(change.mods_per_file(grouped), "run_id", "file_path", "n_modifications") == [("r1", "other.py", 1), ("r1", "src/config.py", 2), ("r4", "w.py", 1)]
    done = spark.createDataFrame([("a", "x", 2), ("a", "y", None), ("b", "z", 3)], "run_id string, file_path string, modifications_applied bigint")
    assert rows(change.generation_summary(done)) == [("a", False, 2, 1, 1), ("b", True, 3, 1, 0)]
    assert rows(change.failed_files(done)) == [("a", "y", "Failed to process file: y")]
    assert dict(rows(edit_eligible(mods, ["run_id", "pos"]).where("run_id = 'r4'"), "run_id", "eligible")) == {"r4": False}


DOC = "one\ntwo\none"
EDIT_CASES = [
    # (edits as action, line, old, new; status, text, applied, skipped)
    ([], "unchanged", DOC, 0, 0),
    ([("add", 1, None, " top ")], "edited", "top\none\ntwo\none", 1, 0),
    ([("add", 3, None, "x"), ("add", 1, None, "y")], "edited", "y\none\ntwo\nx\none", 2, 0),
    ([("add", 2, None, "first"), ("add", 2, None, "second")], "edited", "one\nsecond\nfirst\ntwo\none", 2, 0),
    ([("add", 4, None, "end"), ("add", 0, None, "last"), ("add", None, None, "")], "edited", "one\ntwo\none\nend\nlast\n", 3, 0),
    ([("modify", 0, " one ", "$1\\ .*")], "edited", "$1\\ .*\ntwo\none", 1, 0),
    ([("modify", 0, "one", "two"), ("delete", 0, "two", None)], "edited", "\ntwo\none", 2, 0),
    ([("delete", 0, "two", None), ("delete", 0, "two", None)], "rejected", None, 0, 0),
    ([("delete", 9, "one", None), ("modify", 5, "one", "1")], "edited", "\ntwo\n1", 2, 0),
    ([("modify", 0, "one", " "), ("rename", 0, "a", "b"), (None, 0, None, None), ("delete", 0, "\none", "")], "edited", "\ntwo\none", 1, 3),
    ([("modify", 0, None, "x")], "ineligible", None, 0, 0),
    ([("add", 1, None, "x" * 501)], "ineligible", None, 0, 0),
    ([("add", 1, None, "x" * 500), ("delete", 0, "x" * 500 + "\n", None)], "edited", "x" * 500 + "\n" + DOC, 1, 0),
]


def test_edits(spark):
    docs = spark.createDataFrame([(i, DOC) for i in range(len(EDIT_CASES))], "id int, text string")
    flat = [(i, n, *e) for i, case in enumerate(EDIT_CASES) for n, e in enumerate(case[0])]
    edits = spark.createDataFrame(flat, "id int, seq int, action string, line_number int, old_code string, new_code string")
    got = {r.id: (r.status, r.text, r.edits_applied, r.edits_skipped) for r in apply_edits(docs, edits, "id", "text").collect()}
    for i, (listed, *want) in enumerate(EDIT_CASES[:-1]):
        assert got[i] == tuple(want), listed
    # A break at the end of the old text is trimmed away with it, so the empty line stays.
    assert got[len(EDIT_CASES) - 1] == ("edited", "\n" + DOC, 2, 0)


def test_edits_without_document(spark):
    docs = spark.createDataFrame([(1, DOC), (None, DOC)], "id int, text string")
    edits = spark.createDataFrame([(2, 0, "add", 1, None, "x"), (None, 0, "add", 1, None, "y"), (1, 0, "add", 1, None, "z")],
                                  "id int, seq int, action string, line_number int, old_code string, new_code string")
    got = sorted((repr(r.id), r.status, r.text) for r in apply_edits(docs, edits, "id", "text").collect())
    assert got == [("1", "edited", "z\n" + DOC), ("2", "missing_document", None), ("None", "missing_document", None), ("None", "unchanged", DOC)]


def test_many_edits_of_one_document(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, text string")
    edits = spark.range(3000).selectExpr("1 as id", "id as seq", "'modify' as action", "0 as line_number",
                                         "concat('a', if(id = 0, '', cast(id as string))) as old_code", "concat('a', id + 1) as new_code")
    got = apply_edits(docs, edits, "id", "text").first()
    assert (got.status, got.text, got.edits_applied) == ("edited", "a3000", 3000)


def step_by_step(text, edits):
    """Edits one after the other, as plainly as they can be written."""
    applied = 0
    for e in edits:
        action, old, new = e["action"], e["old"], e["new"]
        if action == "add":
            lines = text.split("\n")
            if 1 <= e["line_number"] <= len(lines):
                lines.insert(e["line_number"] - 1, new)
            else:
                lines.append(new)
            text = "\n".join(lines)
        elif (action == "modify" and old and new) or (action == "delete" and old):
            if old not in text:
                return None, 0
            text = text.replace(old, new if action == "modify" else "", 1)
        else:
            continue
        applied += 1
    return text, applied


def random_edits(rng, n, text, alphabet, span):
    found = []
    for seq in range(n):
        at = rng.randrange(max(1, len(text)))
        old = text[at:at + rng.randint(1, span)]
        if rng.random() < 0.02:
            old = "".join(rng.choice(alphabet) for _ in range(3))
        action = rng.choice(["modify"] * 6 + ["delete", "add", "add", "other"])
        new = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, span)))
        found.append({"seq": seq, "action": action, "line_number": rng.choice([0, 0, rng.randint(-1, 40)]), "old": old, "new": new})
    return sorted(found, key=lambda e: (-max(e["line_number"], 0), e["seq"]))


def test_sweep_equals_steps(monkeypatch):
    rng = random.Random(11)
    kept, batches = 0, []
    real = sweep.independent
    monkeypatch.setattr(sweep, "independent", lambda *a: batches.append(real(*a)) or batches[-1])
    for case in range(400):
        monkeypatch.setattr(sweep, "PART", rng.choice([7, 50, 1 << 14]))
        monkeypatch.setattr(sweep, "FEW", rng.choice([1, 3]))
        monkeypatch.setattr(sweep, "PLAIN", rng.choice([1, 4]))
        monkeypatch.setattr(sweep, "LONGEST", rng.choice([5, 4096]))
        alphabet = rng.choice(["ab\n", "abcdefghijklmnop \n", "aéß漢😀\n"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 20, 400, 3000])))
        edits = random_edits(rng, rng.choice([1, 5, 40]), text, alphabet, rng.choice([2, 6, 12]))
        want, applied = step_by_step(text, edits)
        got = sweep.edit_text(text, edits)
        assert (got["text"], got["applied"]) == (want, applied), (case, text, edits)
        kept += want is not None
    assert kept > 150 and max(map(len, batches)) > 10


def test_long_lists_in_spark_equal_steps(spark):
    rng = random.Random(2)
    words = [f"{w}{i}" for i in range(900) for w in ("alpha", "beta")]
    text = "\n".join(" ".join(rng.sample(words, 12)) for _ in range(300))
    lists = {0: [("modify", 0, w, w.upper()) for w in dict.fromkeys(text.split())][:500], 1: [("add", n % 310, None, f"new {n}") for n in range(200)],
             2: [("delete", 0, "alpha", None)] * 60, 3: [("modify", 0, "none", "x")] * 60, 4: [("add", 3, None, "few")]}
    docs = spark.createDataFrame([(i, text) for i in lists] + [(9, None)], "id int, text string")
    flat = [(i, n, *e) for i, own in lists.items() for n, e in enumerate(own)] + [(9, n, "add", 1, None, "x") for n in range(40)]
    edits = spark.createDataFrame(flat, "id int, seq int, action string, line_number int, old_code string, new_code string")
    got = {r.id: (r.status, r.text, r.edits_applied) for r in apply_edits(docs, edits, "id", "text").collect()}
    for i, own in lists.items():
        ordered = sorted(({"seq": n, "action": a, "line_number": k, "old": o or "", "new": w or ""} for n, (a, k, o, w) in enumerate(own)),
                         key=lambda e: (-e["line_number"], e["seq"]))
        want, applied = step_by_step(text, ordered)
        assert got[i] == (("edited", want, applied) if want is not None else ("rejected", None, 0)), i


def test_line_delta_matches_counting(spark):
    rng = random.Random(2)
    data = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "\r\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(data, "id int, old string, new string")
    got = {}
    for r in line_delta(df, "id", "old", "new").orderBy("id", "line_no").collect():
        got.setdefault(r.id, []).append((r.flag, r.line))
    for i, old, new in data:
        left, want = Counter(old.splitlines()), []
        for line in new.splitlines():
            want.append((" " if left[line] > 0 else "+", line))
            left[line] -= 1
        assert got.get(i, []) == want
    only = line_delta(spark.createDataFrame([(1, "a\nb", "a\nX\nb")], "id int, old string, new string"), "id", "old", "new")
    assert [r.line for r in only.where("flag = '+'").collect()] == ["X"]


def test_scores_reduce_before_they_join(spark):
    plans, mods = frames(spark)
    text = plan(change.alignment(plans, mods, requests(spark)))
    assert "partial_max" in text and "NestedLoop" not in text
