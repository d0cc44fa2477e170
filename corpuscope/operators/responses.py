"""Typed contracts over answers that hold JSON, and coercion of stored strings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.responses import extract_block, extract_code, json_kind, repair_json, value_kind
from corpuscope.functions.text import strip


@dataclass(frozen=True)
class Field:
    """One field of a contract: required, or with a default; optionally limited to values, or open to null.

    ``type`` is string, int, double, boolean, array<string>, map<string,string>, or struct or list, whose content ``fields``
    describes.
    """

    name: str
    type: str
    required: bool = True
    default: Any = None
    allowed: tuple = ()
    nullable: bool = False
    fields: tuple = field(default_factory=tuple)


# The contracts of the answers.
MODIFICATION = [
    Field("action", "string"),
    Field("target_type", "string"),
    Field("target_name", "string"),
    Field("line_number", "int", False, 0, nullable=True),
    Field("old_code", "string", False, "", nullable=True),
    Field("new_code", "string"),
    Field("explanation", "string"),
    Field("affects_dependencies", "array<string>", False, (), nullable=True),
    Field("user_intent_alignment", "double", False, 0.0, nullable=True),
]
FILE_ANALYSIS = [
    Field("needs_modification", "boolean"),
    Field("modification_type", "string", False, "", (
        "data_loading", "data_transformation", "output_handling", "configuration", "utility", "new_file",
        "dependency_update", "testing", "Migration"), nullable=True),
    Field("priority", "string", False, "low", ("high", "medium", "low")),
    Field("reason", "string"),
    Field("cross_file_dependencies", "map<string,string>", False, None, nullable=True),
]
INTENT = [
    Field("core_intent", "string"),
    Field("context_notes", "string"),
    Field("success", "boolean", False, True),
    Field("message", "string", False, "Intent extracted successfully"),
]
QUERY_ENHANCEMENT = [
    Field("developer_task", "string"),
    Field("is_satisfied", "boolean"),
    Field("suggestions", "array<string>", False, ()),
    Field("success", "boolean", False, True),
    Field("message", "string", False, "Query enhanced successfully"),
    Field("reason", "string"),
    Field("change_type", "string"),
]

CHANGE_PLAN = [
    Field("modifications", "list", False, (), fields=tuple(MODIFICATION)),
    Field("new_dependencies", "array<string>", False, ()),
    Field("testing_suggestions", "array<string>", False, ()),
    Field("potential_issues", "array<string>", False, ()),
    Field("cross_file_impacts", "array<string>", False, (), nullable=True),
    Field("implementation_notes", "array<string>", False, (), nullable=True),
    Field("alignment_score", "double", False, 0.0, nullable=True),
]
TARGET_FILES = [
    Field("success", "boolean"),
    Field("message", "string"),
    Field("files_to_modify", "list", False, (), fields=(
        Field("file_path", "string"),
        Field("file_info", "map<string,string>"),
        Field("analysis", "struct", fields=tuple(FILE_ANALYSIS)),
        Field("priority", "string", allowed=("high", "medium", "low")),
    )),
]

# Texts that stand for a truth value.
TRUE_TEXTS = ["true", "t", "yes", "y", "on", "1"]
FALSE_TEXTS = ["false", "f", "no", "n", "off", "0"]


def _ddl(f: Field) -> str:
    if not f.fields:
        return f.type
    inner = "struct<" + ",".join(f"`{x.name}`:{_ddl(x)}" for x in f.fields) + (",`reject_reason`:string>" if f.type == "list" else ">")
    return f"array<{inner}>" if f.type == "list" else inner


def _default(f: Field) -> Column:
    if f.fields or isinstance(f.default, tuple):
        return (F.array(*[F.lit(x) for x in f.default or ()]) if f.type != "struct" else F.lit(None)).cast(_ddl(f))
    return F.lit(f.default).cast(f.type)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once wherever ``use`` refers to it: expressions in a lambda are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _value(raw: Column, kind: Column, f: Field) -> Column:
    """Typed value of a variant, NULL where it does not fit; that of a struct, and elements of a list, say what is wrong inside them.

    Numeric text is a number, a number is no text; whole numbers may be written with a point; some texts and 0 and 1
    stand for truth values. ``kind`` is the variant's type.
    """
    def got(as_type):
        return F.try_variant_get(raw, "$", as_type)

    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    text, flag = F.when(kind == "STRING", got("string")), F.when(kind == "BOOLEAN", got("boolean"))
    match f.type:
        case "string":
            return text
        case "int" | "bigint":
            whole = F.when(number & (got("double") == F.floor(got("double"))), got("double"))
            written = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+(?:\.0*)?$"), F.trim(text).try_cast("double"))
            exact = F.when(kind == "BIGINT", got("bigint"))
            return F.coalesce(exact, F.coalesce(whole, written, flag.cast("double")).try_cast("bigint")).try_cast(f.type)
        case "double":
            return F.coalesce(F.when(number, got("double")), F.trim(text).try_cast("double"), flag.cast("double"))
        case "boolean":
            word = F.lower(text)
            one = F.when(kind == "BIGINT", got("bigint"))
            return F.coalesce(flag, F.when(word.isin(TRUE_TEXTS) | (one == 1), True).when(word.isin(FALSE_TEXTS) | (one == 0), False))
        case "array<string>":
            items = F.when(F.startswith(kind, F.lit("ARRAY")), got("array<variant>"))
            fits = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
            return F.when(fits, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
        case "map<string,string>":
            items = F.when(F.startswith(kind, F.lit("OBJECT")), got("map<string,variant>"))
            return F.transform_values(items, lambda _, x: F.when(
                F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))
        case "struct":
            return F.when(F.startswith(kind, F.lit("OBJECT")), _object(raw, f.fields))
        case "list":
            return F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(got("array<variant>"), lambda x: _object(x, f.fields, "wrong type")))
    raise ValueError(f"unknown type {f.type}")


def _cell(obj: Column, f: Field) -> Column:
    """A field of an object: its value, the default filled in, and whether it is absent, null, of another type or refused."""
    def told(raw, kind, found):
        absent = raw.isNull()
        null = kind == "VOID"
        value, inner = found, F.lit(None).cast("string")
        if f.type == "struct":
            value = F.when(found.isNotNull(), F.struct(*[found[x.name].alias(x.name) for x in f.fields]))
            inner = F.when(~absent & ~null, F.concat(F.lit(f.name + ": "), found["reject_reason"]))
        # A given null is not the default: it is kept where the field is open to it.
        filled = F.when(absent, _default(f) if not f.required else F.lit(None).cast(_ddl(f))).when(null, F.lit(None).cast(_ddl(f))).otherwise(value)
        refused = F.lit(False)
        if f.allowed:
            refused = ~absent & ~null & ~found.isin(*f.allowed, *([f.default] if f.default is not None else []))
        return F.struct(filled.alias("value"), absent.alias("absent"), null.alias("null"), (~absent & ~null & found.isNull()).alias("wrong"),
                        refused.alias("refused"), inner.alias("inner"))

    raw = F.try_variant_get(obj, f"$['{f.name}']", "variant")
    return _once(raw, lambda r: _once(F.schema_of_variant(r), lambda kind: _once(_value(r, kind, f), lambda found: told(r, kind, found))))


def _object(obj: Column, contract, no_object: str | None = None) -> Column:
    """The fields of an object and ``reject_reason``, the first thing that is wrong with it: ``no_object`` if it is none.

    Each field is looked up, typed and checked once.
    """
    def told(cells):
        missing = [(cells[f.name]["absent"], f"missing {f.name}") for f in contract if f.required]
        wrong = [(cells[f.name][c], text + f.name) for f in contract for c, text in (("null", "null "), ("wrong", "wrong type "))
                 if c == "wrong" or not f.nullable]
        refused = [(cells[f.name]["refused"], f"invalid {f.name}") for f in contract if f.allowed]
        other = F.lit(False)
        if no_object:
            other = ~F.coalesce(F.startswith(F.schema_of_variant(obj), F.lit("OBJECT")), F.lit(False))
        reason = F.when(other, F.lit(no_object).cast("string"))
        for condition, message in [*missing, *wrong, *refused]:
            reason = reason.when(condition, F.lit(message))
        inner = F.coalesce(*[cells[f.name]["inner"] for f in contract])
        return F.struct(*[cells[f.name]["value"].alias(f.name) for f in contract], reason.otherwise(inner).alias("reject_reason"))

    return _once(F.struct(*[_cell(obj, f).alias(f.name) for f in contract]), told)


def parse_contract(df: DataFrame, col: str, contract: list[Field]) -> DataFrame:
    """Parse a JSON column by its contract.

    Adds the fields (defaults filled in) and ``reject_reason``: NULL for good rows, else what is wrong first: malformed
    JSON, a missing required field, a null or a value of another type, a value that is not allowed, the same inside a
    struct. Elements of a list carry a ``reject_reason`` of their own (see :func:`contract_elements`).
    """
    # Exploding the one value keeps later filters above the parse and the check, so each text is parsed and checked once.
    rows = df.select("*", F.explode(F.array(F.try_parse_json(F.col(col)))).alias("__v"))
    rows = rows.select("*", F.explode(F.array(_object(F.col("__v"), contract, "malformed"))).alias("__c"))
    return rows.withColumns({c: F.col("__c")[c] for c in [*(f.name for f in contract), "reject_reason"]}).drop("__v", "__c")


def contract_elements(parsed: DataFrame, name: str, keys) -> DataFrame:
    """One row per element of a list field: keys, pos, its fields and ``reject_reason`` with the place of the element."""
    rows = parsed.where(F.col("reject_reason").isNull()).select(*keys, F.posexplode(name).alias("pos", "__e"))
    inner = [c for c in rows.select("__e.*").columns if c != "reject_reason"]
    place = F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]: "), F.col("__e.reject_reason"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), *[F.col(f"__e.{c}").alias(c) for c in inner], place.alias("reject_reason"))


def good_and_rejects(parsed: DataFrame, contract: list[Field], keys) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and keys with the reason of those that do not."""
    good = parsed.where(F.col("reject_reason").isNull()).select(*keys, *[f.name for f in contract])
    bad = parsed.where(F.col("reject_reason").isNotNull()).select(*keys, "reject_reason")
    return good, bad


def parse_responses(df: DataFrame, text: str, contract: list[Field]) -> DataFrame:
    """Block extraction, repair and contract in one projection."""
    return parse_contract(df.withColumn("__json", repair_json(text)), "__json", contract).drop("__json")


def response_blocks(df: DataFrame, text: str, keys) -> DataFrame:
    return df.select(*keys, extract_block(text).alias("block"))


def code_blocks(df: DataFrame, text: str, keys) -> DataFrame:
    return df.select(*keys, extract_code(text).alias("code"))


def coerce_values(df: DataFrame, value: str, keys) -> DataFrame:
    """Kind and typed value of stored strings; lists and maps keep their JSON text.

    The parse and the kind are columns of their own, so each string is parsed once.
    """
    text = F.col(value)
    parsed = df.select(*keys, value, json_kind(value).alias("__json"))
    kinds = parsed.select(*keys, value, "__json", value_kind(text, F.col("__json")).alias("kind"))
    kind = F.col("kind")
    unquoted = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return kinds.select(
        *keys,
        "kind",
        F.when(kind == "int", text.try_cast("bigint")).alias("int_value"),
        F.when(kind == "float", text.try_cast("double")).alias("float_value"),
        F.when(kind == "bool", F.lower(text) == "true").alias("bool_value"),
        F.when(F.col("__json") == "STRING", unquoted).when(kind.isin("string", "list", "dict"), text).alias("text_value"),
    )


def user_turns(turns: DataFrame, turn: str = "turn", text: str = "text") -> DataFrame:
    """Turns at even positions, trimmed."""
    return turns.where(F.col(turn) % 2 == 0).withColumn(text, strip(text))
