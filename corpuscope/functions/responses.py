"""Fenced blocks, JSON repair and scalar coercion as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import BLANKS, any_of, as_col, strip

# What opens a line of code in an unfenced answer.
CODE_TEXT_STARTS = ["import ", "from ", "def ", "class ", "#", "if __name__"]
CODE_LINE_STARTS = [
    "import ", "from ", "def ", "class ", "if __name__", "#",
    "@", "async def", "try:", "with ", "for ", "while ", "if ",
]
CODE_INDENT = "   "


def extract_block(c) -> Column:
    """First ```json block, else first fenced block, else the whole text; trimmed.

    A fence that is never closed reaches to the end of the text.
    """
    text = as_col(c)
    block = (
        F.when(F.contains(text, F.lit("```json")), F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1))
        .when(F.contains(text, F.lit("```")), F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1))
        .otherwise(text)
    )
    return strip(block)


def extract_code(c) -> Column:
    """First closed ```python block, else first closed block, else from the first line that looks like code."""
    text = as_col(c)
    trimmed = strip(text)
    starts = "|".join(re.escape(s) for s in CODE_LINE_STARTS)
    # One search over the whole text: a blank line, an indented line, or a line that starts like code.
    code_line = rf"(?dmU)^(?:{CODE_INDENT}|{BLANKS}*(?:$|{starts}))"
    first = F.regexp_instr(text, F.lit(code_line))
    return (
        F.when(text.rlike(r"(?s)```python.*?```"), strip(F.regexp_extract(text, r"(?s)```python(.*?)```", 1)))
        .when(text.rlike(r"(?s)```.*?```"), strip(F.regexp_extract(text, r"(?s)```(.*?)```", 1)))
        .when(any_of(F.startswith(trimmed, F.lit(s)) for s in CODE_TEXT_STARTS), trimmed)
        .when(first > 0, strip(F.substr(text, first)))
        .otherwise(trimmed)
    )


def outer_braces(c) -> Column:
    """From the first opening to the last closing brace; the text itself when there is none."""
    text = as_col(c)
    start = F.instr(text, "{")
    tail = F.substr(text, start)
    last = F.length(tail) - F.instr(F.reverse(tail), "}") + 1
    return (
        F.when(start == 0, text)
        .when(F.contains(tail, F.lit("}")), F.substr(tail, F.lit(1), last))
        .otherwise(tail)
    )


def repair_json(c, braces: bool = True, join_lines: bool = False) -> Column:
    """Fenced text (or outer braces), Python booleans to JSON, trailing commas dropped."""
    text = as_col(c)
    fence = r"(?s)```(?:json)?(.*?)```"
    unfenced = outer_braces(text) if braces else text
    body = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(unfenced)
    if join_lines:
        body = F.replace(body, F.lit("\n"), F.lit(""))
    body = F.replace(body, F.lit("True"), F.lit("true"))
    body = F.replace(body, F.lit("False"), F.lit("false"))
    return strip(F.regexp_replace(body, r"(?U),\s*([}\]])", "$1"))


def json_kind(c) -> Column:
    """Type name of a JSON text, NULL when it is none. A variant keeps big numbers and nested values without a schema."""
    return F.schema_of_variant(F.try_parse_json(as_col(c)))


def value_kind(text: Column, parsed: Column) -> Column:
    """Kind of a stored string: JSON first, then digits, then booleans, else text."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(parsed == "VOID", F.lit("null"))
        .when(parsed == "BIGINT", F.lit("int"))
        .when(parsed == "DOUBLE", F.lit("float"))
        .when(F.startswith(parsed, F.lit("DECIMAL")),
              F.when(text.rlike(r"^\s*-?[0-9]+\s*$"), F.lit("int")).otherwise(F.lit("float")))
        .when(parsed == "BOOLEAN", F.lit("bool"))
        .when(parsed == "STRING", F.lit("string"))
        .when(F.startswith(parsed, F.lit("ARRAY")), F.lit("list"))
        .when(F.startswith(parsed, F.lit("OBJECT")), F.lit("dict"))
        .when(text.rlike("^[0-9]+$"), F.lit("int"))
        .when(F.lower(text).isin("true", "false"), F.lit("bool"))
        .otherwise(F.lit("string"))
    )


def stored(value: Column, kind: str) -> Column:
    """Store form of a typed value: JSON text for lists and maps, True/False for booleans, else plain text."""
    if kind in ("list", "dict"):
        return F.to_json(value)
    if kind == "bool":
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    return value.cast("string")
