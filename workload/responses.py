"""Registered response-parsing queries with their SQL: every order is an answer in one of several shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.responses import repair_json, stored
from corpuscope.operators.responses import (
    CHANGE_PLAN,
    FILE_ANALYSIS,
    MODIFICATION,
    code_blocks,
    coerce_values,
    contract_elements,
    good_and_rejects,
    parse_responses,
    response_blocks,
    user_turns,
)
from workload.tables import CTES, source_files, sql, table


def answers(spark, sf):
    """``answer_id, text``: fenced, bare-fenced, in prose, with trailing commas, with Python booleans, or no JSON at all."""
    key = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 7
    body = F.concat(
        F.lit('{"action": "modify", "target_type": "order", "target_name": "order_'), key, F.lit('", "line_number": '),
        (F.col("o_custkey") % 100).cast("string"), F.lit(',\n "new_code": "x = '), key, F.lit('", "explanation": "status '),
        F.col("o_orderstatus"), F.lit('"'))
    text = (
        F.when(shape == 0, F.concat(F.lit("Answer:\n```json\n"), body, F.lit("}\n```\nDone {ok}.")))
        .when(shape == 1, F.concat(F.lit("```\n"), body, F.lit(', "user_intent_alignment": 0.5}\n``` and ```more```')))
        .when(shape == 2, F.concat(F.lit("Sure! "), body, F.lit(', "old_code": "y"} Hope it helps.')))
        .when(shape == 3, F.concat(F.lit("  "), body, F.lit(', "affects_dependencies": ["a.py", "b.py",\n ],\n}  ')))
        .when(shape == 4, F.concat(F.lit('{"action": "add", "confirmed": True, "line_number": "x'), key, F.lit('"}')))
        .when(shape == 5, F.concat(F.lit('{"action": "add", "checked": False, "explanation": "'), key, F.lit('"}')))
        .otherwise(F.concat(F.lit("No change needed for "), key))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("answer_id"), text.alias("text"))


CTES["answers"] = """
    SELECT o_orderkey AS answer_id, CASE o_orderkey % 7
        WHEN 0 THEN 'Answer:' || chr(10) || '```json' || chr(10) || body || '}' || chr(10) || '```' || chr(10) || 'Done {ok}.'
        WHEN 1 THEN '```' || chr(10) || body || ', "user_intent_alignment": 0.5}' || chr(10) || '``` and ```more```'
        WHEN 2 THEN 'Sure! ' || body || ', "old_code": "y"} Hope it helps.'
        WHEN 3 THEN '  ' || body || ', "affects_dependencies": ["a.py", "b.py",' || chr(10) || ' ],' || chr(10) || '}  '
        WHEN 4 THEN '{"action": "add", "confirmed": True, "line_number": "x' || o_orderkey || '"}'
        WHEN 5 THEN '{"action": "add", "checked": False, "explanation": "' || o_orderkey || '"}'
        ELSE 'No change needed for ' || o_orderkey END AS text
    FROM (SELECT *, '{"action": "modify", "target_type": "order", "target_name": "order_' || o_orderkey || '", "line_number": '
          || (o_custkey % 100) || ',' || chr(10) || ' "new_code": "x = ' || o_orderkey || '", "explanation": "status ' || o_orderstatus || '"' AS body
          FROM orders)
"""
SPACES = r"' ' || chr(9) || chr(10) || chr(13)"


def answer_blocks(spark, sf):
    return response_blocks(answers(spark, sf), "text", ["answer_id"])


ANSWER_BLOCKS = sql(rf"""
    SELECT answer_id, trim(CASE WHEN contains(text, '```json') THEN split_part(split_part(text, '```json', 2), '```', 1)
        WHEN contains(text, '```') THEN split_part(text, '```', 2) ELSE text END, {SPACES}) AS block
    FROM answers
""")


def wrapped_code(spark, sf):
    """Source files as answers: fenced as Python, fenced, after a line of prose, or as they are."""
    shape = F.col("order_key") % 4
    fence = F.lit("```")
    text = (
        F.when(shape == 0, F.concat(F.lit("Here:\n```python\n"), "content", fence, F.lit("\nBye.")))
        .when(shape == 1, F.concat(fence, F.lit("\n"), "content", fence))
        .when(shape == 2, F.concat(F.lit("This is the file\nyou want\n"), "content"))
        .otherwise(F.concat(F.lit("\n"), "content"))
    )
    return source_files(spark, sf).select("order_key", text.alias("text"))


def code_answers(spark, sf):
    return code_blocks(wrapped_code(spark, sf), "text", ["order_key"])


CODE_ANSWERS = sql(f"SELECT order_key, trim(content, {SPACES}) AS code FROM source_files")


def repaired_answers(spark, sf):
    return answers(spark, sf).select("answer_id", repair_json("text").alias("json"), repair_json("text", False, True).alias("joined"))


def repair_sql(body):
    return rf"trim(regexp_replace(replace(replace({body}, 'True', 'true'), 'False', 'false'), ',\s*([}}\]])', '\1', 'g'), {SPACES})"


FENCED = r"regexp_matches(text, '(?s)```(?:json)?(.*?)```')"
FENCE_BODY = rf"trim(regexp_extract(text, '(?s)```(?:json)?(.*?)```', 1), {SPACES})"
BRACES = r"CASE WHEN contains(text, '{') THEN regexp_extract(text, '(?s)\{.*\}') ELSE text END"
CTES["repaired"] = f"""
    SELECT answer_id, {repair_sql(f'CASE WHEN {FENCED} THEN {FENCE_BODY} ELSE {BRACES} END')} AS json,
           {repair_sql(f'replace(CASE WHEN {FENCED} THEN {FENCE_BODY} ELSE text END, chr(10), $$$$)')} AS joined
    FROM answers
"""
REPAIRED_ANSWERS = sql("SELECT * FROM repaired")


def parsed_modifications(spark, sf):
    parsed = parse_responses(answers(spark, sf), "text", MODIFICATION)
    good, _ = good_and_rejects(parsed, MODIFICATION, ["answer_id"])
    return good.withColumn("affects_dependencies", F.array_join("affects_dependencies", ","))


# The check knows the fields from the order itself, not from the text.
PARSED_MODIFICATIONS = """
    SELECT o_orderkey AS answer_id, 'modify' AS action, 'order' AS target_type, 'order_' || o_orderkey AS target_name,
           (o_custkey % 100)::INTEGER AS line_number, CASE WHEN o_orderkey % 7 = 2 THEN 'y' ELSE '' END AS old_code,
           'x = ' || o_orderkey AS new_code, 'status ' || o_orderstatus AS explanation,
           CASE WHEN o_orderkey % 7 = 3 THEN 'a.py,b.py' ELSE '' END AS affects_dependencies,
           CASE WHEN o_orderkey % 7 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS user_intent_alignment
    FROM orders WHERE o_orderkey % 7 < 4
"""


def rejected_modifications(spark, sf):
    parsed = parse_responses(answers(spark, sf), "text", MODIFICATION)
    return good_and_rejects(parsed, MODIFICATION, ["answer_id"])[1]


REJECTED_MODIFICATIONS = """
    SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 7 IN (4, 5) THEN 'missing target_type' ELSE 'malformed' END AS reject_reason
    FROM orders WHERE o_orderkey % 7 >= 4
"""


def file_analyses(spark, sf):
    rank = F.lower(F.substring("o_orderpriority", 3, 20))
    text = F.concat(
        F.lit('```json\n{"needs_modification": '), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(', "priority": "'), rank, F.lit('"'))).otherwise(F.lit("")),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(', "modification_type": "utility"'))
        .when(F.col("o_custkey") % 3 == 1, F.lit(', "modification_type": "rewrite"')).otherwise(F.lit("")),
        F.lit(', "reason": "r'), F.col("o_orderkey"), F.lit('",}\n```'))
    parsed = parse_responses(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "text", FILE_ANALYSIS)
    return parsed.select("o_orderkey", "needs_modification", "modification_type", "priority", "reason", "reject_reason")


FILE_ANALYSES = """
    SELECT *, CASE WHEN modification_type = 'rewrite' THEN 'invalid modification_type'
                   WHEN priority NOT IN ('high', 'medium', 'low') THEN 'invalid priority' END AS reject_reason
    FROM (SELECT o_orderkey, o_orderstatus = 'F' AS needs_modification,
                 CASE o_custkey % 3 WHEN 0 THEN 'utility' WHEN 1 THEN 'rewrite' ELSE '' END AS modification_type,
                 CASE WHEN o_orderstatus = 'P' THEN 'low' ELSE lower(substr(o_orderpriority, 3)) END AS priority,
                 'r' || o_orderkey AS reason FROM orders)
"""


def plan_answers(spark, sf):
    """One answer per customer with a modification for each order, some of them against the contract."""
    key = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 6
    line = (F.col("o_custkey") % 100).cast("string")
    number = F.when(shape == 0, F.concat(F.lit('"'), line, F.lit('"'))).when(shape == 3, "null").when(shape == 4, '"x"').otherwise(line)
    element = F.concat(
        F.lit('{"action": '), F.when(shape == 1, "7").otherwise('"modify"'), F.lit(', "target_type": "order", "target_name": "order_'), key,
        F.lit('", "line_number": '), number, F.when(shape == 2, "").otherwise(F.concat(F.lit(', "new_code": "x = '), key, F.lit('"'))),
        F.lit(', "explanation": "e"}'))
    listed = table(spark, sf, "orders").select("o_custkey", "o_orderkey", element.alias("e")).groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "e"))).alias("l"))
    text = F.concat(F.lit('```json\n{"modifications": ['), F.array_join("l.e", ", "), F.lit('], "alignment_score": "0.5",}\n```'))
    return listed.select("o_custkey", text.alias("text"))


def plan_elements(spark, sf):
    parsed = parse_responses(plan_answers(spark, sf), "text", CHANGE_PLAN)
    return contract_elements(parsed, "modifications", ["o_custkey", "alignment_score"]).select(
        "o_custkey", "alignment_score", "pos", "action", "target_name", "line_number", "new_code", "old_code", "reject_reason")


PLAN_ELEMENTS = """
    SELECT o_custkey, 0.5::DOUBLE AS alignment_score, pos, CASE WHEN shape <> 1 THEN 'modify' END AS action, 'order_' || o_orderkey AS target_name,
           CASE WHEN shape NOT IN (3, 4) THEN (o_custkey % 100)::INTEGER END AS line_number,
           CASE WHEN shape <> 2 THEN 'x = ' || o_orderkey END AS new_code, '' AS old_code,
           'modifications[' || pos || ']: ' || CASE shape WHEN 1 THEN 'wrong type action' WHEN 2 THEN 'missing new_code'
               WHEN 4 THEN 'wrong type line_number' END AS reject_reason
    FROM (SELECT *, o_orderkey % 6 AS shape, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
"""


def stored_values(spark, sf):
    """Every event's fields as stored strings, one per row."""
    key = F.col("event_id").cast("string")
    cells = F.array(
        F.struct(F.lit("props").alias("field"), F.col("props").alias("value")),
        F.struct(F.lit("type").alias("field"), F.col("event_type").alias("value")),
        F.struct(F.lit("user").alias("field"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit("padded").alias("field"), F.concat(F.lit("00"), key).alias("value")),
        F.struct(F.lit("flag").alias("field"), F.when(F.col("event_type") == "error", "False").otherwise("True").alias("value")),
        F.struct(F.lit("json_flag").alias("field"), F.when(F.col("event_type") == "error", "null").otherwise("true").alias("value")),
        F.struct(F.lit("quoted").alias("field"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value")),
        F.struct(F.lit("list").alias("field"), F.concat(F.lit("["), key, F.lit(', "a"]')).alias("value")),
        F.struct(F.lit("ratio").alias("field"), F.concat(F.col("user_id"), F.lit("e-1")).alias("value")),
    )
    return table(spark, sf, "events").select("event_id", F.explode(cells).alias("c")).select("event_id", "c.*")


def coerced_values(spark, sf):
    return coerce_values(stored_values(spark, sf), "value", ["event_id", "field"])


COERCED_VALUES = """
    SELECT event_id, 'props' AS field, 'dict' AS kind, NULL::BIGINT AS int_value, NULL::DOUBLE AS float_value,
           NULL::BOOLEAN AS bool_value, props AS text_value FROM events
    UNION ALL SELECT event_id, 'type', 'string', NULL, NULL, NULL, event_type FROM events
    UNION ALL SELECT event_id, 'user', 'int', user_id, NULL, NULL, NULL FROM events
    UNION ALL SELECT event_id, 'padded', 'int', event_id, NULL, NULL, NULL FROM events
    UNION ALL SELECT event_id, 'flag', 'bool', NULL, NULL, event_type <> 'error', NULL FROM events
    UNION ALL SELECT event_id, 'json_flag', CASE WHEN event_type = 'error' THEN 'null' ELSE 'bool' END, NULL, NULL,
                     CASE WHEN event_type <> 'error' THEN true END, NULL FROM events
    UNION ALL SELECT event_id, 'quoted', 'string', NULL, NULL, NULL, event_type FROM events
    UNION ALL SELECT event_id, 'list', 'list', NULL, NULL, NULL, '[' || event_id || ', "a"]' FROM events
    UNION ALL SELECT event_id, 'ratio', 'float', NULL, user_id / 10.0::DOUBLE, NULL, NULL FROM events
"""


def store_forms(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        stored(F.array("event_type", F.lit("x")), "list").alias("list_text"),
        stored(F.col("event_type") == "error", "bool").alias("bool_text"),
        stored(F.col("user_id"), "int").alias("int_text"),
    )


STORE_FORMS = """
    SELECT event_id, '["' || event_type || '","x"]' AS list_text, CASE WHEN event_type = 'error' THEN 'True' ELSE 'False' END AS bool_text,
           user_id::VARCHAR AS int_text FROM events
"""


def even_turns(spark, sf):
    return user_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


EVEN_TURNS = f"SELECT conv_id, turn, trim(text, {SPACES}) AS text FROM conversations WHERE turn % 2 = 0"

QUERIES = {
    "extract_block": (answer_blocks, ANSWER_BLOCKS),
    "extract_code": (code_answers, CODE_ANSWERS),
    "repair_json": (repaired_answers, REPAIRED_ANSWERS),
    "parse_contract": (parsed_modifications, PARSED_MODIFICATIONS),
    "contract_rejects": (rejected_modifications, REJECTED_MODIFICATIONS),
    "file_analysis_contract": (file_analyses, FILE_ANALYSES),
    "contract_elements": (plan_elements, PLAN_ELEMENTS),
    "coerce_values": (coerced_values, COERCED_VALUES),
    "stored_values": (store_forms, STORE_FORMS),
    "user_turns": (even_turns, EVEN_TURNS),
}
