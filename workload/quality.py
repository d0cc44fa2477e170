"""Registered rule-scan, metric and validation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators.quality import (
    COMPLEXITY_TOKENS,
    PERFORMANCE,
    SECURITY,
    Rule,
    code_metrics,
    complexity,
    route_findings,
    scan_rules,
    top_issues,
    validate,
    validate_checked,
    validation_summary,
)
from corpuscope.operators.symbols import import_edges, lint_findings, symbol_counts, symbol_index
from corpuscope.operators.rules import scan_rule_table
from corpuscope.plans.recheck import check_changed
from corpuscope.plans.validation import check_files, record_passed, run_changes
from corpuscope.session import shared_dir
from corpuscope.sources.ledger import read_ledger
from workload.tables import CTES, kept_source_files, source_files, sql, table

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def re2(rule):
    """The rule's pattern with Unicode spaces and word characters, which RE2 knows by category only."""
    body = rule.pattern.replace(r"\s", SPACE).replace(r"\w", WORD).replace("'", "''")
    return f"'{'(?i)' if rule.ignore_case else ''}{body}'"


PREFIX = {"security": "Security Warning: ", "performance": "Performance: "}


def rules_sql(source, text, keys, rules):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{r.rule_id}' AS rule_id, '{r.kind}' AS kind, '{r.severity}' AS severity, "
        f"'{PREFIX[r.kind]}{r.message}' AS message FROM {source} WHERE regexp_matches({text}, {re2(r)})"
        for r in rules
    )


def security_scan(spark, sf):
    return scan_rules(table(spark, sf, "documents"), SECURITY, "text", ["doc_id", "source"])


SECURITY_SCAN = rules_sql("documents", "text", "doc_id, source", SECURITY)


# Pages hold no code: what every page has and what some have.
PAGE_RULES = [
    Rule("script", "security", "low", r"<\s*script", "Script in a page", "script"),
    Rule("link", "performance", "links", r"<a\s+href=[\"\']\w+", "Link to another page", "href", False),
    *SECURITY,
]


def security_scan_pages(spark, sf):
    return scan_rules(table(spark, sf, "pages"), PAGE_RULES, "html", ["page_id"])


SECURITY_SCAN_PAGES = rules_sql("pages", "html", "page_id", PAGE_RULES)


def code_scan(spark, sf):
    return scan_rules(source_files(spark, sf), SECURITY + PERFORMANCE, "content", ["file_path"])


CTES["code_findings"] = rules_sql("source_files", "content", "file_path", SECURITY + PERFORMANCE)
CODE_SCAN = sql("SELECT * FROM code_findings")


def document_metrics(spark, sf):
    return code_metrics(table(spark, sf, "documents"), "text", ["doc_id"])


BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'"


def count_sql(text, token):
    return f"((length({text}) - length(replace({text}, '{token}', ''))) // {len(token)})"


def metrics_sql(source, text, key):
    return rf"""
    SELECT {key}, len(lines) AS lines_of_code,
           len(list_filter(lines, lambda x: regexp_full_match(x, '{SPACE}*'))) AS blank_lines,
           len(list_filter(lines, lambda x: regexp_matches(x, '^{SPACE}*#'))) AS comment_lines,
           {count_sql(text, 'def ')} AS functions_count, {count_sql(text, 'class ')} AS classes_count,
           {count_sql(text, 'import ')} + {count_sql(text, 'from ')} AS imports_count
    FROM (SELECT {key}, {text}, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines
          FROM (SELECT {key}, {text}, regexp_split_to_array({text}, {BREAK}) AS parts FROM {source}))
    """


DOCUMENT_METRICS = metrics_sql("documents", "text", "doc_id")


def source_metrics(spark, sf):
    return code_metrics(source_files(spark, sf), "content", ["file_path"])


SOURCE_METRICS = sql(metrics_sql("source_files", "content", "file_path"))


def document_complexity(spark, sf):
    return complexity(table(spark, sf, "documents"), "text", ["doc_id", "lang"])


def complexity_sql(source, text, keys):
    total = " + ".join(count_sql(text, t) for t in COMPLEXITY_TOKENS)
    return f"""
    SELECT {keys}, score AS complexity_score,
           CASE WHEN score > 20 THEN 'high' WHEN score > 10 THEN 'medium' ELSE 'low' END AS complexity_estimate
    FROM (SELECT {keys}, {total} AS score FROM {source})"""


DOCUMENT_COMPLEXITY = complexity_sql("documents", "text", "doc_id, lang")


def source_complexity(spark, sf):
    return complexity(source_files(spark, sf), "content", ["file_path"])


SOURCE_COMPLEXITY = sql(complexity_sql("source_files", "content", "file_path"))


def checked_files(spark, sf):
    """All findings of the source files, with a row for each file, from one read."""
    return check_files(source_files(spark, sf), keys=["file_path", "customer_key"])


# The check reads line numbers off the text: the bound files hold a known set of statements.
CTES["numbered"] = """
    SELECT file_path, generate_subscripts(parts, 1)::BIGINT AS line, unnest(parts) AS txt
    FROM (SELECT file_path, string_split(content, chr(10)) AS parts FROM source_files)
"""
CTES["broken"] = "SELECT file_path FROM source_files WHERE contains(content, 'if a == 1 print(a)')"
CTES["linted"] = r"""
    SELECT file_path, 'static' AS kind, 'bare_except' AS rule_id, 'warning' AS severity, line,
           'Line ' || line || ': Bare except clause detected' AS message
    FROM numbered WHERE txt = 'except:' AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'static', 'unused_variable', 'suggestion', line, 'Line ' || line || ': Variable _tmp appears unused'
    FROM numbered WHERE starts_with(txt, '_tmp = ') AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'static', 'missing_docstring', 'warning', line,
           'Line ' || line || ': FunctionDef ''' || regexp_extract(txt, 'def (\w+)', 1) || ''' missing docstring'
    FROM numbered WHERE starts_with(txt, 'def ') AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'syntax', 'syntax_error', 'error', 0, '' FROM broken
"""


def lint(spark, sf):
    found = lint_findings(source_files(spark, sf))
    # The text of a syntax error is the Python version's own.
    message = F.when(F.col("kind") == "syntax", "").otherwise(F.col("message"))
    return found.select("file_path", "kind", "rule_id", "severity", "line", message.alias("message"))


LINT = sql("SELECT file_path, kind, rule_id, severity, line, message FROM linted")


def symbols(spark, sf):
    found = symbol_index(source_files(spark, sf))
    return found.select("file_path", "kind", "name", "line", F.coalesce(F.array_join("args", ","), F.lit("")).alias("args"))


CTES["symbols"] = r"""
    SELECT file_path, 'function' AS kind, regexp_extract(txt, 'def (\w+)', 1) AS name, line,
           replace(regexp_extract(txt, '\((.*)\)', 1), ' ', '') AS args
    FROM numbered WHERE starts_with(txt, 'def ') AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'class', regexp_extract(txt, 'class (\w+)', 1), line, ''
    FROM numbered WHERE starts_with(txt, 'class ') AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'import', CASE WHEN starts_with(txt, 'from ') THEN 'pyspark.sql.functions' ELSE substr(txt, 8) END, line, ''
    FROM numbered WHERE (starts_with(txt, 'import ') OR starts_with(txt, 'from ')) AND file_path NOT IN (FROM broken)
    UNION ALL
    SELECT file_path, 'variable', regexp_extract(txt, '^\s*(\w+) = ', 1), line, ''
    FROM numbered WHERE regexp_matches(txt, '^\s*\w+ = ') AND file_path NOT IN (FROM broken)
"""
SYMBOLS = sql("SELECT * FROM symbols")


def symbol_kinds(spark, sf):
    return symbol_counts(symbol_index(source_files(spark, sf)), ["kind", "name"])


SYMBOL_KINDS = sql("SELECT kind, name, count(*) AS symbols FROM symbols GROUP BY kind, name")


def file_edges(spark, sf):
    files = source_files(spark, sf)
    return import_edges(symbol_index(files), files)


FILE_EDGES = sql("""
    SELECT DISTINCT s.file_path AS source, s.name AS module, f.file_path AS target, 1::BIGINT AS n_targets
    FROM symbols s JOIN source_files f ON s.name = 'order_' || f.order_key
    WHERE kind = 'import' AND s.file_path <> f.file_path
""")

CTES["findings"] = """
    SELECT file_path, rule_id, kind, severity, message FROM code_findings
    UNION ALL SELECT file_path, rule_id, kind, severity, message FROM linted
"""


def routed_sql(strict):
    return f"""
    SELECT *, CASE kind WHEN 'syntax' THEN 'error' WHEN 'security' THEN '{'error' if strict else 'warning'}'
                        WHEN 'performance' THEN 'suggestion' ELSE severity END AS level
    FROM findings WHERE kind = 'syntax' OR file_path NOT IN (FROM broken)"""


CTES["routed"] = routed_sql(False)
CTES["routed_strict"] = routed_sql(True)


def validated_sql(source, strict, reported):
    return f"""
    SELECT f.file_path, folder, f.file_path NOT IN (FROM broken) AS syntax_valid, e AS errors, w AS warnings, g AS suggestions,
           {reported} AS reported_warnings, e = 0 {'AND w = 0' if strict else ''} AS validation_passed
    FROM source_files f JOIN (
        SELECT s.file_path, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w,
               count(*) FILTER (level = 'suggestion') AS g
        FROM source_files s LEFT JOIN {source} r ON r.file_path = s.file_path GROUP BY s.file_path) c ON c.file_path = f.file_path"""


CTES["validated"] = validated_sql("routed", False, "w")
CTES["validated_strict"] = validated_sql("routed_strict", True, "0::BIGINT")


def without_folder(df):
    return df.select("file_path", "syntax_valid", "errors", "warnings", "suggestions", "reported_warnings", "validation_passed")


def file_validation(spark, sf):
    return without_folder(validate_checked(checked_files(spark, sf), ["file_path"]))


FILE_VALIDATION = sql("SELECT * EXCLUDE (folder) FROM validated")


def file_validation_strict(spark, sf):
    return without_folder(validate_checked(checked_files(spark, sf), ["file_path"], strict=True, skip_warnings=True))


FILE_VALIDATION_STRICT = sql("SELECT * EXCLUDE (folder) FROM validated_strict")


def rechecked_files(spark, sf):
    """The source files checked once, then again after one order in five has got a line more: the rest is not checked twice."""
    (files, passes), path = kept_source_files(spark, sf), shared_dir(spark, "findings")
    keys = ["file_path", "order_key"]
    check_changed(files, path, keys=keys, passes=passes)
    longer = F.when(F.col("order_key") % 5 == 0, F.concat("content", F.lit("global done\n"))).otherwise(F.col("content"))
    again = check_changed(files.withColumn("content", longer), path, keys=keys, passes=passes)
    return again.select("file_path", "rule_id", "kind", "severity", "known")


RECHECKED_FILES = sql("""
    SELECT f.file_path, rule_id, kind, severity, order_key % 5 <> 0 AS known FROM source_files f JOIN (
        SELECT file_path, rule_id, kind, severity FROM findings
        UNION ALL SELECT file_path, 'global', 'performance', 'scope' FROM source_files WHERE order_key % 5 = 0
        UNION ALL SELECT file_path, NULL, NULL, NULL FROM source_files) r ON r.file_path = f.file_path
""")


def benchmark_rules(spark, sf):
    """A rule for each benchmark item, its first two words next to each other, and the security rules as rows."""
    words = F.split("text", " ")
    pair = F.concat(words[0], F.lit(r"\s+"), words[1])
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item_"), "item_id").alias("rule_id"), F.lit("security").alias("kind"), F.lit("low").alias("severity"),
        pair.alias("pattern"), F.lit("First words of an item").alias("message"), F.lit(None).cast("string").alias("word"),
        (F.col("item_id") % 2 == 0).alias("ignore_case"))
    return items.where(pair.rlike(r"^[A-Za-z]+\\s\+[A-Za-z]+$")).unionByName(spark.createDataFrame(SECURITY, items.schema))


def rule_table_scan(spark, sf):
    return scan_rule_table(table(spark, sf, "documents"), benchmark_rules(spark, sf), "text", ["doc_id", "source"])


RULE_TABLE_SCAN = SECURITY_SCAN + r"""
    UNION ALL
    SELECT doc_id, source, 'item_' || item_id, 'security', 'low', 'Security Warning: First words of an item'
    FROM documents d JOIN (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) b
        ON regexp_matches(d.text, CASE WHEN item_id % 2 = 0 THEN '(?i)' ELSE '' END || w[1] || '\s+' || w[2])
    WHERE regexp_full_match(w[1], '[A-Za-z]+') AND regexp_full_match(w[2], '[A-Za-z]+')
""".replace(r"\s", SPACE)


def folder_summary(spark, sf):
    per_file = validate_checked(checked_files(spark, sf), ["file_path"])
    folder = F.element_at(F.split("file_path", "/"), 2)
    return validation_summary(per_file.withColumn("folder", folder), ["folder"])


def summary_sql(source, by, warned):
    return f"""
    SELECT *, greatest(0, least(100, 100 - 10 * total_errors - 2 * total_warnings))::DOUBLE AS overall_quality_score,
           CASE WHEN total_errors > 0 THEN 'failed' WHEN total_warnings > 0 THEN '{warned}' ELSE 'passed' END AS overall_status,
           'passed' AS legacy_status
    FROM (SELECT {by}, count(*) AS total_files, count(*) FILTER (errors > 0) AS files_with_errors,
                 count(*) FILTER (warnings > 0) AS files_with_warnings, count(*) FILTER (validation_passed) AS files_passed,
                 sum(errors)::BIGINT AS total_errors, sum(warnings)::BIGINT AS total_warnings,
                 sum(suggestions)::BIGINT AS total_suggestions
          FROM {source} GROUP BY {by})"""


FOLDER_SUMMARY = sql(summary_sql("validated", "folder", "warning"))


def source_summary(spark, sf):
    """Security findings of the documents rolled up by source."""
    docs = table(spark, sf, "documents")
    findings = scan_rules(docs, SECURITY, "text", ["doc_id", "source"])
    return validation_summary(validate(docs, findings, ["doc_id", "source"]), ["source"])


SOURCE_SUMMARY = f"""
    WITH found AS ({SECURITY_SCAN}),
    per_doc AS (SELECT d.doc_id, d.source, 0 AS errors, count(rule_id) AS warnings, 0 AS suggestions, true AS validation_passed
                FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id, d.source)
    {summary_sql('per_doc', 'source', 'warning')}"""


def run_summary_strict(spark, sf):
    """One validation run per customer, strict."""
    per_file = validate_checked(checked_files(spark, sf), ["file_path", "customer_key"], strict=True)
    return validation_summary(per_file, ["customer_key"], strict=True)


RUN_SUMMARY_STRICT = sql(
    summary_sql("(SELECT v.*, customer_key FROM validated_strict v JOIN source_files s ON s.file_path = v.file_path)",
                "customer_key", "failed"))


def top_file_issues(spark, sf):
    findings = checked_files(spark, sf).where(F.col("kind").isNotNull()).withColumnRenamed("customer_key", "run_id")
    routed = route_findings(findings, strict=True)
    message = F.when(F.col("kind") == "syntax", "").otherwise(F.col("message")).alias("message")
    found = top_issues(routed, ["run_id"], ["file_path", "kind", "rule_id", "message"], 5, 3)
    return found.select("run_id", "level", "rank", "file_path", "kind", "rule_id", message)


TOP_FILE_ISSUES = sql("""
    SELECT run_id, level, rank, file_path, kind, rule_id, message FROM (
        SELECT customer_key AS run_id, level, r.file_path, kind, rule_id, message,
               row_number() OVER (PARTITION BY customer_key, level ORDER BY r.file_path, kind, rule_id, message) AS rank
        FROM routed_strict r JOIN source_files s ON s.file_path = r.file_path WHERE level IN ('error', 'warning'))
    WHERE rank <= CASE level WHEN 'error' THEN 5 ELSE 3 END
""")

def source_edits(spark, sf):
    """An edit of two files in three: the first import becomes a guarded one, in files that have none it cannot be applied."""
    return source_files(spark, sf).where("order_key % 3 > 0").select(
        "file_path", F.lit(0).alias("seq"), F.lit("modify").alias("action"), F.lit(0).alias("line_number"),
        F.lit("import ").alias("old_code"), F.lit("global lib # import").alias("new_code"))


def change_pipeline(spark, sf):
    """Edits of each customer's files applied and validated; passed runs go to the ledger, which is read back."""
    files = source_files(spark, sf).withColumnRenamed("customer_key", "run_id")
    runs = run_changes(files, source_edits(spark, sf), strict=True, lint=False)
    out = shared_dir(spark, "ledger")
    record_passed(runs, out, F.lit("2024-05-01 10:00:00").cast("timestamp"))
    saved = read_ledger(spark, out).select(F.col("user_id").cast("bigint").alias("saved_run"), "validation_status")
    return runs.join(saved, F.col("run_id") == F.col("saved_run"), "left").select(
        "run_id", "files_edited", "files_not_edited", "total_files", "total_errors", "total_suggestions", "overall_status", "passed",
        "validation_status")


CTES["changed_sources"] = """
    SELECT file_path, customer_key AS run_id, status, CASE status WHEN 'edited' THEN
               substr(content, 1, instr(content, 'import') - 1) || 'global lib # import' || substr(content, instr(content, 'import') + 6)
               ELSE content END AS content
    FROM (SELECT *, CASE WHEN order_key % 3 = 0 THEN 'unchanged' WHEN contains(content, 'import') THEN 'edited' ELSE 'rejected' END AS status
          FROM source_files)
"""
CTES["usable_sources"] = "SELECT * FROM changed_sources WHERE status <> 'rejected'"
CTES["changed_findings"] = rules_sql("usable_sources", "content", "file_path, run_id", SECURITY + PERFORMANCE)
CHANGE_PIPELINE = sql("""
    SELECT *, CASE WHEN passed THEN 'PASSED' END AS validation_status FROM (
        SELECT *, files_not_edited = 0 AND coalesce(overall_status, 'passed') <> 'failed' AS passed FROM (
            SELECT run_id, files_edited, files_not_edited, total_files, total_errors, total_suggestions,
                   CASE WHEN total_errors > 0 THEN 'failed' WHEN total_files IS NOT NULL THEN 'passed' END AS overall_status
            FROM (SELECT run_id, count(*) FILTER (status = 'edited') AS files_edited, count(*) FILTER (status = 'rejected') AS files_not_edited,
                         nullif(count(*) FILTER (status <> 'rejected'), 0) AS total_files FROM changed_sources GROUP BY run_id)
            LEFT JOIN (SELECT u.run_id, count(*) FILTER (kind = 'security') AS total_errors, count(*) FILTER (kind = 'performance') AS total_suggestions
                       FROM usable_sources u LEFT JOIN changed_findings f ON f.file_path = u.file_path GROUP BY u.run_id) USING (run_id)))
""")

QUERIES = {
    "security_scan": (security_scan, SECURITY_SCAN),
    "security_scan_pages": (security_scan_pages, SECURITY_SCAN_PAGES),
    "code_scan": (code_scan, CODE_SCAN),
    "rule_table_scan": (rule_table_scan, RULE_TABLE_SCAN),
    "code_metrics": (document_metrics, DOCUMENT_METRICS),
    "source_metrics": (source_metrics, SOURCE_METRICS),
    "complexity": (document_complexity, DOCUMENT_COMPLEXITY),
    "source_complexity": (source_complexity, SOURCE_COMPLEXITY),
    "lint_findings": (lint, LINT),
    "symbol_index": (symbols, SYMBOLS),
    "symbol_counts": (symbol_kinds, SYMBOL_KINDS),
    "import_edges": (file_edges, FILE_EDGES),
    "validate": (file_validation, FILE_VALIDATION),
    "validate_strict": (file_validation_strict, FILE_VALIDATION_STRICT),
    "recheck_files": (rechecked_files, RECHECKED_FILES),
    "validation_summary": (folder_summary, FOLDER_SUMMARY),
    "source_summary": (source_summary, SOURCE_SUMMARY),
    "run_summary_strict": (run_summary_strict, RUN_SUMMARY_STRICT),
    "top_issues": (top_file_issues, TOP_FILE_ISSUES),
    "change_pipeline": (change_pipeline, CHANGE_PIPELINE),
}
