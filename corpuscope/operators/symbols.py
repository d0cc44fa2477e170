"""Syntax trees of Python sources as rows, and lint findings, symbols and import edges told from them in Spark.

Python only parses: it lists the nodes of a tree, without looking for anything. Rules and symbols are Spark expressions over
the nodes of a file, which refer to each other by place.
"""

from __future__ import annotations

import ast
from collections import deque
from functools import cache, reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Function lengths that warn and fail.
LONG_FUNCTION = 50
TOO_LONG_FUNCTION = 100

PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)

# A node: its class, its name (of a constant: the type of its value), the field of its parent it stands in and the place there,
# its lines, and where its parent and its children are in the list, counted from 1; level by level, so children are neighbours.
NODE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("place", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("last_line", T.LongType()),
    T.StructField("parent", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("children", T.IntegerType()),
])
PARSED = T.StructType([T.StructField("error", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])

NAMED = ("name", "id", "arg", "attr", "module")
# Nodes that are listed unless all are asked for: statements and their parts, and the expressions that rules read.
STATEMENTS = (ast.stmt, ast.excepthandler, ast.match_case, ast.arguments, ast.arg, ast.alias)
READ = {(ast.Assign, "targets"), (ast.ExceptHandler, "type"), (ast.Expr, "value")}
# Fields that can hold such nodes.
HOLDING = {"body", "orelse", "finalbody", "handlers", "cases", "names", "args", "posonlyargs", "kwonlyargs", "vararg", "kwarg"}
# Nodes that are held as Python objects before they become Arrow columns.
AT_ONCE = 1 << 16


@cache
def _class(kind: type, whole: bool) -> tuple:
    """Of a class of nodes: its name, the field of a node's name, whether it is listed, and its fields with whether all in them is."""
    named = next((a for a in NAMED if a in kind._fields), None)
    inside = whole or not issubclass(kind, ast.expr)
    read = [(f, whole or (kind, f) in READ) for f in kind._fields if inside]
    return kind.__name__, named, issubclass(kind, STATEMENTS), [(f, every) for f, every in read if every or f in HOLDING]


def _listed(text: str, whole: bool):
    """The nodes of a text's tree, level by level, as tuples of ``NODE``."""
    waiting = deque([(ast.parse(text), None, 0, 0)])
    at, listed = 0, 1
    while waiting:
        node, field, place, parent = waiting.popleft()
        at, before = at + 1, listed
        kind, named, _, fields = _class(type(node), whole)
        for name, every in fields:
            value = getattr(node, name, None)
            for i, child in enumerate(value) if type(value) is list else ((0, value),):
                if isinstance(child, ast.AST) and (every or _class(type(child), whole)[2]):
                    waiting.append((child, name, i, at))
                    listed += 1
        name = type(node.value).__name__ if kind == "Constant" else getattr(node, named, None) if named else None
        yield (kind, name if type(name) is str else None, field, place, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0), parent, before + 1,
               listed - before)


def _chunk(rows) -> pa.StructArray:
    node = to_arrow_type(NODE)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), node)], fields=list(node))


@cache
def _parse():
    """Column function: the error or the listed nodes of each text; NULL for a missing text."""
    node, result = to_arrow_type(NODE), to_arrow_type(PARSED)

    def run(texts: pa.Array) -> pa.Array:
        chunks, rows, ends, errors = [pa.array([], node)], [], [0], []
        for text in texts:
            found, error = [], None
            try:
                found = list(_listed(text.as_py(), False)) if text.is_valid else []
            except PARSE_ERRORS as problem:
                error = str(problem)
            rows += found
            errors.append(error)
            ends.append(ends[-1] + len(found))
            if len(rows) >= AT_ONCE:
                chunks.append(_chunk(rows))
                rows = []
        nodes = pa.concat_arrays([*chunks, _chunk(rows)] if rows else chunks)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes).cast(result.field("nodes").type)
        return pa.StructArray.from_arrays([pa.array(errors, pa.string()), lists], fields=list(result), mask=texts.is_null())

    return F.arrow_udf(run, PARSED)


def _node_rows(batches):
    """Arrow function: (file_path, node, all nodes) of files, a bounded number at a time."""
    for batch in batches:
        for path, text in zip(batch.column(0), batch.column(1)):
            try:
                nodes = enumerate(_listed(text.as_py(), True), 1)
                while rows := list(islice(nodes, AT_ONCE)):
                    fields = _chunk([r for _, r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), *fields.flatten()],
                        ["file_path", "node", *NODE.names])
            except PARSE_ERRORS:
                continue


def parsed(content) -> Column:
    """``error, nodes`` of a text: statements and what rules read of them. Only the text goes to Python; name it as a column."""
    return _parse()(content)


def _dealt(files: DataFrame, *keys) -> DataFrame:
    """Texts over all shuffle partitions: a parse costs far more than the bytes that Spark packs tasks by."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _trees(files: DataFrame) -> DataFrame:
    """``file_path, __tree`` of files."""
    return _dealt(files.select("file_path", "content"), "file_path").select("file_path", parsed("content").alias("__tree"))


def syntax_nodes(files: DataFrame) -> DataFrame:
    """A row for each node of each file that parses: file_path, node (its number) and the fields of ``NODE``.

    ``parent`` and ``first`` are numbers of nodes of the same file: joined on (file_path, parent) = (file_path, node) a node
    meets its parent. A file without text has a ``Module`` only; one that does not parse, or is NULL, has no rows.
    """
    source = _dealt(files.where(F.col("content").isNotNull()).select("file_path", "content"), "file_path")
    return source.mapInArrow(_node_rows, "file_path string, node int, " + NODE.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


def _children(nodes, n, *tests) -> Column:
    """Children of a node that meet all tests."""
    return F.filter(F.slice(nodes, n["first"], n["children"]), lambda c: reduce(Column.__and__, [t(c) for t in tests]))


def _in(*fields):
    return lambda c: c["field"].isin(*fields)


def _is(*kinds):
    return lambda c: c["kind"].isin(*kinds)


def _finding(kind, rule, severity, line, message) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), severity.alias("severity"), F.concat(*message).alias("message"),
                    line.cast("bigint").alias("line"))


def _at(line) -> list:
    return [F.lit("Line "), line, F.lit(": ")]


def _node_findings(nodes, n) -> Column:
    """Findings at one node, in the order of the rules."""
    line = n["line"]
    caught = _children(nodes, n, _in("type"))
    bare = _finding("static", "bare_except", "warning", line, [*_at(line), F.lit("Bare except clause detected")])
    private = _children(nodes, n, _in("targets"), _is("Name"), lambda c: c["name"].startswith("_") & ~c["name"].startswith("__"))
    unused = F.transform(private, lambda c: _finding(
        "static", "unused_variable", "suggestion", line, [*_at(line), F.lit("Variable "), c["name"], F.lit(" appears unused")]))
    span = n["last_line"] - line
    worst = span > TOO_LONG_FUNCTION
    length = _finding(
        "static", "function_length", F.when(worst, "error").otherwise("warning"), line,
        [*_at(line), F.lit("Function '"), n["name"], F.lit("' is "), F.when(worst, "too").otherwise("very"), F.lit(" long ("), span, F.lit(" lines)")])
    opening = _children(nodes, n, _in("body"), lambda c: c["place"] == 0, _is("Expr"))
    documented = F.exists(opening, lambda e: F.size(_children(nodes, e, _is("Constant"), lambda c: c["name"] == "str")) > 0)
    undocumented = _finding("static", "missing_docstring", "warning", line, [*_at(line), n["kind"], F.lit(" '"), n["name"], F.lit("' missing docstring")])
    none = F.array().cast(FOUND)
    return F.when(_is("ExceptHandler")(n) & (F.size(caught) == 0), F.array(bare)).when(_is("Assign")(n), unused).when(
        _is("FunctionDef", "ClassDef")(n),
        F.concat(F.when(_is("FunctionDef")(n) & (span > LONG_FUNCTION), F.array(length)).otherwise(none),
                 F.when(~documented, F.array(undocumented)).otherwise(none))).otherwise(none)


FOUND = T.ArrayType(T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("rule_id", "kind", "severity", "message")], T.StructField("line", T.LongType())]))


def tree_findings(tree: str) -> Column:
    """Findings (rule_id, kind, severity, message, line) of a ``parsed`` column: a syntax error, or those of its nodes; none for NULL."""
    nodes = F.col(f"{tree}.nodes")
    broken = _finding("syntax", "syntax_error", "error", F.lit(0), [F.lit("Syntax Error: "), F.col(f"{tree}.error")])
    found = F.flatten(F.transform(nodes, lambda n: _node_findings(nodes, n)))
    return F.when(F.col(f"{tree}.error").isNotNull(), F.array(broken)).otherwise(F.coalesce(found, F.array().cast(FOUND)))


def lint_findings(files: DataFrame) -> DataFrame:
    """Findings of every file: syntax error, or bare excepts, unused names, long functions, missing docstrings."""
    found = _trees(files.where(F.col("content").isNotNull())).select("file_path", F.posexplode(tree_findings("__tree")).alias("at", "f"))
    return found.select("file_path", F.col("at").cast("bigint").alias("pos"), "f.kind", "f.rule_id", "f.severity", "f.line", "f.message")


def _node_symbols(nodes, n) -> Column:
    """What one node declares: functions with the names of their plain parameters, classes, imports, assigned names."""
    kind, line = n["kind"], n["line"]

    def symbol(what, name, args=None):
        args = F.lit(None).cast("array<string>") if args is None else args
        return F.struct(F.lit(what).alias("kind"), name.alias("name"), line.alias("line"), args.alias("args"))

    lists = _children(nodes, n, _in("args"), _is("arguments"))
    args = F.flatten(F.transform(lists, lambda a: F.transform(_children(nodes, a, _in("args")), lambda c: c["name"])))
    aliases = _children(nodes, n, _in("names"), _is("alias"))
    origin = F.concat(F.coalesce(n["name"], F.lit("")), F.lit("."))
    names = _children(nodes, n, _in("targets"), _is("Name"))
    return F.when(kind == "FunctionDef", F.array(symbol("function", n["name"], args))).when(
        kind == "ClassDef", F.array(symbol("class", n["name"]))).when(
        kind == "Import", F.transform(aliases, lambda c: symbol("import", c["name"]))).when(
        kind == "ImportFrom", F.transform(aliases, lambda c: symbol("import", F.concat(origin, c["name"])))).when(
        kind == "Assign", F.transform(names, lambda c: symbol("variable", c["name"])))


def symbol_index(files: DataFrame) -> DataFrame:
    """Functions, classes, imports and assigned names of every file that parses."""
    nodes = F.col("__tree.nodes")
    declared = F.flatten(F.filter(F.transform(nodes, lambda n: _node_symbols(nodes, n)), lambda s: s.isNotNull()))
    found = _trees(files.where(F.length("content") > 0)).select("file_path", F.posexplode(declared).alias("at", "s"))
    return found.select("file_path", F.col("at").cast("bigint").alias("pos"), "s.*")


def symbol_counts(symbols: DataFrame, by=("kind",)) -> DataFrame:
    """Number of symbols per kind, or per file and kind."""
    return symbols.groupBy(*by).agg(F.count(F.lit(1)).alias("symbols"))


def import_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of files of the same tree: one row per importing file and module.

    An import names a module, or a module and something in it. A file is the module if its path ends with the module's:
    ``pkg.mod`` is ``src/pkg/mod.py`` or ``src/pkg/mod/__init__.py``. The whole name goes before the name without its last
    part, and a file below the importer's own folder before the others. ``target`` is NULL where several files are left;
    ``n_targets`` is their number. Both lookups have one row per name, so a common name does not pair every importer with
    every file.
    """
    place = F.regexp_replace("file_path", r"(?:/__init__)?\.py$", "")
    parts = F.split(place, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    by_end = files.select(F.explode(ends).alias("module"), "file_path").groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.min("file_path").alias("only"))
    by_place = files.select(place.alias("place"), "file_path").groupBy("place").agg(F.min("file_path").alias("near"))
    name = F.btrim(F.col("name"), F.lit("."))
    folder = F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1)
    whole = F.struct(F.lit(1).alias("rank"), name.alias("module"))
    front = F.struct(F.lit(2).alias("rank"), F.regexp_replace(name, r"\.[^.]*$", "").alias("module"))
    options = F.when(F.contains(name, F.lit(".")), F.array(whole, front)).otherwise(F.array(whole))
    asked = symbols.where(F.col("kind") == "import").select(
        F.col("file_path").alias("source"), "name", folder.alias("folder"), F.explode(options).alias("o")).distinct()
    asked = asked.select("source", "name", "o.rank", "o.module", F.concat("folder", F.replace("o.module", F.lit("."), F.lit("/"))).alias("place"))
    found = asked.join(by_place, "place", "left").join(by_end, "module", "left").where("near is not null or n is not null")
    target = F.coalesce("near", F.when(F.col("n") == 1, F.col("only")))
    count = F.when(F.col("near").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("n"))
    best = found.groupBy("source", "name").agg(F.min(F.struct("rank", "module", target.alias("target"), count.alias("n_targets"))).alias("b"))
    edges = best.select("source", "b.module", "b.target", "b.n_targets").distinct()
    return edges.where(F.col("target").isNull() | (F.col("target") != F.col("source")))
