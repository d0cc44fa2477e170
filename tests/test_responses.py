import json

import pytest

from corpuscope.functions.responses import extract_block, extract_code, repair_json
from corpuscope.operators.responses import (CHANGE_PLAN, FILE_ANALYSIS, INTENT, MODIFICATION, TARGET_FILES, coerce_values, contract_elements,
                                             good_and_rejects, parse_responses, user_turns)
from tests.conftest import plan, rows

ANSWERS = [
    "x ```json\n{\"a\": 1}\n``` y ```z```", "```\n[1]\n```", "  plain  ", "```json\nopen {", "a ``` b ``` c", "",
    "```python\nimport x\n``` tail", "```python\nno end", "Hello\nimport os\nrun()", "Hello\n\nx", "Hello\n    y = 1\nz", "Hello there", "  def f(): pass ",
    "Some {\"a\": True, \"b\": [1, 2,],\n} text }", "no braces", "{ open", "} first { then } last", "if x:\n  y", "Text\r\n\r\nfor z",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(ANSWERS)), "id int, t string")


BLOCKS = ['{"a": 1}', "[1]", "plain", "open {", "b", "", "python\nimport x", "python\nno end", "Hello\nimport os\nrun()", "Hello\n\nx",
          "Hello\n    y = 1\nz", "Hello there", "def f(): pass", 'Some {"a": True, "b": [1, 2,],\n} text }', "no braces", "{ open",
          "} first { then } last", "if x:\n  y", "Text\r\n\r\nfor z"]
CODE = ['json\n{"a": 1}', "[1]", "plain", "```json\nopen {", "b", "", "import x", "```python\nno end", "import os\nrun()", "x", "y = 1\nz",
        "Hello there", "def f(): pass", 'Some {"a": True, "b": [1, 2,],\n} text }', "no braces", "{ open", "} first { then } last", "if x:\n  y", "for z"]
REPAIRED = ['{"a": 1}', "[1]", "plain", "{", "b", "", "python\nimport x", "```python\nno end", "Hello\nimport os\nrun()", "Hello\n\nx",
            "Hello\n    y = 1\nz", "Hello there", "def f(): pass", '{"a": true, "b": [1, 2]} text }', "no braces", "{ open", "{ then }", "if x:\n  y",
            "Text\r\n\r\nfor z"]


@pytest.mark.parametrize("column, wanted", [(extract_block, BLOCKS), (extract_code, CODE), (repair_json, REPAIRED)])
def test_text_functions(spark, column, wanted):
    got = {r.id: r.v for r in frame(spark).select("id", column("t").alias("v")).collect()}
    for i, t in enumerate(ANSWERS):
        assert got[i] == wanted[i], repr(t)


def test_contract(spark):
    base = {"action": "add", "target_type": "function", "target_name": "f", "new_code": "x", "explanation": "e"}
    data = [(1, json.dumps(base)), (2, json.dumps({**base, "line_number": "seven"})), (3, json.dumps({k: v for k, v in base.items() if k != "new_code"})),
            (4, "no"), (5, json.dumps({**base, "old_code": None, "extra": 1, "affects_dependencies": ["a"]})), (6, None)]
    parsed = parse_responses(spark.createDataFrame(data, "id int, t string"), "t", MODIFICATION)
    good, bad = good_and_rejects(parsed, MODIFICATION, ["id"])
    kept = {r.id: r for r in good.collect()}
    assert sorted(kept) == [1, 5] and kept[1].line_number == 0 and kept[1].old_code == "" and kept[5].affects_dependencies == ["a"]
    assert kept[5].old_code is None
    assert dict(rows(bad)) == {2: "wrong type line_number", 3: "missing new_code", 4: "malformed", 6: "malformed"}


def test_enums_and_defaults(spark):
    data = [(1, '{"needs_modification": True, "reason": "r"}'), (2, '{"needs_modification": false, "reason": "r", "priority": "urgent"}'),
            (3, '{"needs_modification": false, "reason": "r", "modification_type": "Migration", "priority": "high"}')]
    parsed = parse_responses(spark.createDataFrame(data, "id int, t string"), "t", FILE_ANALYSIS)
    got = {r.id: (r.priority, r.modification_type, r.reject_reason) for r in parsed.collect()}
    assert got == {1: ("low", "", None), 2: ("urgent", "", "invalid priority"), 3: ("high", "Migration", None)}
    intent = parse_responses(spark.createDataFrame([(1, '{"core_intent": "a", "context_notes": ""}')], "id int, t string"), "t", INTENT).first()
    assert intent.success is True and intent.message == "Intent extracted successfully" and intent.reject_reason is None


def test_each_answer_is_parsed_once(spark):
    parsed = parse_responses(frame(spark), "t", MODIFICATION)
    good, _ = good_and_rejects(parsed, MODIFICATION, ["id"])
    assert plan(good).lower().count("parsejson") == 1


BASE = {"action": "add", "target_type": "t", "target_name": "n", "new_code": "c", "explanation": "e"}
# Changes to a good answer, and the value or the reason that follows.
TYPES = [
    ({"line_number": "5"}, "line_number", 5), ({"line_number": 5.0}, "line_number", 5), ({"line_number": True}, "line_number", 1),
    ({"line_number": None}, "line_number", None), ({"line_number": " 7 "}, "line_number", 7), ({"line_number": 5.5}, None, "wrong type line_number"),
    ({"line_number": 12345678901}, None, "wrong type line_number"), ({"line_number": [1]}, None, "wrong type line_number"),
    ({"action": 7}, None, "wrong type action"), ({"action": None}, None, "null action"), ({"action": ["a"]}, None, "wrong type action"),
    ({"user_intent_alignment": "0.5"}, "user_intent_alignment", 0.5), ({"user_intent_alignment": 1}, "user_intent_alignment", 1.0),
    ({"affects_dependencies": ["a", "b"]}, "affects_dependencies", ["a", "b"]), ({"affects_dependencies": ["a", 1]}, None, "wrong type affects_dependencies"),
    ({"affects_dependencies": "a"}, None, "wrong type affects_dependencies"), ({"affects_dependencies": None}, "affects_dependencies", None),
]


def test_type_rules(spark):
    data = [(i, json.dumps({**BASE, **change})) for i, (change, _, _) in enumerate(TYPES)]
    got = {r.id: r for r in parse_responses(spark.createDataFrame(data, "id int, t string"), "t", MODIFICATION).collect()}
    for i, (change, name, want) in enumerate(TYPES):
        if name:
            assert got[i].reject_reason is None and got[i][name] == want, change
        else:
            assert got[i].reject_reason == want, change


@pytest.mark.parametrize("value, want", [("yes", True), ("OFF", False), (1, True), (0, False), (2, None), ("maybe", None), (True, True)])
def test_truth_values(spark, value, want):
    text = json.dumps({"needs_modification": value, "reason": "r"}).replace("true", "True")
    got = parse_responses(spark.createDataFrame([(1, text)], "id int, t string"), "t", FILE_ANALYSIS).first()
    assert (got.needs_modification, got.reject_reason) == (want, None if want is not None else "wrong type needs_modification")


def test_nested_contracts(spark):
    plan_ = {"modifications": [BASE, {**BASE, "action": 1}, "text", {k: v for k, v in BASE.items() if k != "new_code"}], "testing_suggestions": ["t"]}
    targets = {"success": True, "message": "m", "files_to_modify": [
        {"file_path": "a", "file_info": {"size": 3, "name": "x"}, "analysis": {"needs_modification": True, "reason": "r"}, "priority": "high"},
        {"file_path": "b", "file_info": {}, "analysis": {"needs_modification": True}, "priority": "high"},
        {"file_path": "c", "file_info": {}, "analysis": {"needs_modification": False, "reason": "", "priority": "urgent"}, "priority": "low"}]}
    frame_ = spark.createDataFrame([(1, json.dumps(plan_)), (2, "{}"), (3, '{"modifications": 4}'), (4, '{"modifications": null}')], "id int, t string")
    parsed = parse_responses(frame_, "t", CHANGE_PLAN)
    assert {r.id: r.reject_reason for r in parsed.collect()} == {1: None, 2: None, 3: "wrong type modifications", 4: "null modifications"}
    got = [(r.id, r.pos, r.target_name, r.reject_reason) for r in contract_elements(parsed, "modifications", ["id"]).orderBy("pos").collect()]
    assert got == [(1, 0, "n", None), (1, 1, "n", "modifications[1]: wrong type action"), (1, 2, None, "modifications[2]: wrong type"),
                   (1, 3, "n", "modifications[3]: missing new_code")]
    parsed = parse_responses(spark.createDataFrame([(1, json.dumps(targets).replace("true", "True"))], "id int, t string"), "t", TARGET_FILES)
    rows_ = contract_elements(parsed, "files_to_modify", ["id"]).orderBy("pos").collect()
    assert [r.reject_reason for r in rows_] == [None, "files_to_modify[1]: analysis: missing reason", "files_to_modify[2]: analysis: invalid priority"]
    assert rows_[0].file_info == {"size": "3", "name": "x"} and rows_[0].analysis.priority == "low"


VALUES = ["1", "007", "-3", "1.5", "1e3", "true", "True", "FALSE", "None", "null", "[1, 2]", '{"a": 1}', '"quoted"', "text", "", "12345678901234567890", "{bad"]


TYPED = [1, 7, -3, 1.5, 1000.0, True, True, False, "None", None, [1, 2], {"a": 1}, "quoted", "text", "", 12345678901234567890, "{bad"]


def test_coercion(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "id int, v string")
    for r in coerce_values(df, "v", ["id"]).collect():
        want = TYPED[r.id]
        kind = "null" if want is None else "string" if isinstance(want, str) else type(want).__name__
        assert r.kind == kind, VALUES[r.id]
        if kind == "bool":
            assert r.bool_value is want
        elif kind == "int" and abs(want) < 1 << 62:
            assert r.int_value == want
        elif kind == "float":
            assert r.float_value == want
        elif kind == "string":
            assert r.text_value == want


def test_even_turns(spark):
    df = spark.createDataFrame([(0, " a\n"), (1, "b"), (2, "c")], "turn int, text string")
    assert rows(user_turns(df)) == [(0, "a"), (2, "c")]


def test_each_field_is_looked_up_once(spark):
    """Also in the elements of a list, whose expressions Spark does not share."""
    df = spark.createDataFrame([('{"modifications": [{"action": "a", "target_type": "t", "target_name": "n", "new_code": "c", "explanation": "e", "line_number": 2.0}]}',)], "t string")
    parsed = parse_responses(df, "t", CHANGE_PLAN)
    found = contract_elements(parsed, "modifications", [])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    for name in ("line_number", "action", "modifications", "alignment_score"):
        assert text.count(f"$['{name}']") == 1
    assert found.first().line_number == 2 and found.first().reject_reason is None
