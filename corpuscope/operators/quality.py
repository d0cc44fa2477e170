"""Rule scans, metrics and validation roll-ups over text tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions.text import BLANKS, count_occurrences, folded, line_count, normal_breaks
from corpuscope.operators.topk import first_per_group


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    severity: str
    pattern: str
    message: str
    word: str
    ignore_case: bool = True


# Patterns, messages and severities of the scan, and the word every match holds.
SECURITY = [
    Rule("eval", "security", "high", r"eval\s*\(", "Use of eval() detected - security risk", "eval"),
    Rule("exec", "security", "high", r"exec\s*\(", "Use of exec() detected - security risk", "exec"),
    Rule("input", "security", "medium", r"input\s*\(", "Use of input() - validate inputs", "input"),
    Rule("subprocess", "security", "medium", r"subprocess\.(call|run|Popen)", "Use of subprocess - ensure safe commands", "subprocess."),
    Rule("os_system", "security", "high", r"os\.system\s*\(", "Use of os.system() - injection risk", "os.system"),
    Rule("pickle", "security", "medium", r"pickle\.loads?\s*\(", "Use of pickle - untrusted input risk", "pickle.load"),
    Rule("dynamic_import", "security", "low", r"__import__\s*\(", "Dynamic import - validate input", "__import__"),
    Rule("password", "security", "high", r"""password\s*=\s*["'][^"']+["']""", "Hardcoded password detected", "password"),
    Rule("api_key", "security", "high", r"""api_key\s*=\s*["'][^"']+["']""", "Hardcoded API key detected", "api_key"),
    Rule("secret", "security", "high", r"""secret\s*=\s*["'][^"']+["']""", "Hardcoded secret detected", "secret"),
    Rule("token", "security", "high", r"""token\s*=\s*["'][^"']+["']""", "Hardcoded token detected", "token"),
]
# For these the severity column holds the category.
PERFORMANCE = [
    Rule("range_len", "performance", "iteration", r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(",
         "Use enumerate() instead of range(len())", "range", False),
    Rule("string_concat", "performance", "string_ops", r"\+=.*str", "Use join() for string concatenation in loops", "+=", False),
    Rule("append_loop", "performance", "list_ops", r"\.append\s*\([^)]*for\s+",
         "Use list comprehension instead of appending in loop", ".append", False),
    Rule("global", "performance", "scope", r"global\s+", "Avoid global variables for performance and clarity", "global", False),
]
# Texts put in front of a message.
PREFIX = {"security": "Security Warning: ", "performance": "Performance: "}

# Complexity tokens and thresholds, score weights.
COMPLEXITY_TOKENS = ["if ", "elif ", "else:", "for ", "while ", "try:", "except:", "with "]
COMPLEXITY_LOW = 10
COMPLEXITY_MEDIUM = 20
BASE_SCORE = 100
ERROR_PENALTY = 10
WARNING_PENALTY = 2


def rule_findings(rules, text: str, lowered: str) -> Column:
    """Findings of a text as an array, one per rule that matches.

    A pattern is only tried where its word occurs, which a plain substring search finds much faster. (?U) gives \\s and
    \\w their Unicode meaning, (?d) lets "." pass everything but a line feed. ``lowered`` names the folded text.
    """
    def finding(rule):
        source, flags = (lowered, "(?iUd)") if rule.ignore_case else (text, "(?Ud)")
        return F.when(
            F.contains(F.col(source), F.lit(rule.word)) & F.col(text).rlike(flags + rule.pattern),
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.severity).alias("severity"),
                F.lit(PREFIX.get(rule.kind, "") + rule.message).alias("message"),
            ),
        )

    return F.array_compact(F.array(*[finding(r) for r in rules]))


def scan_rules(docs: DataFrame, rules, text: str, keys) -> DataFrame:
    """One finding per rule that matches a text: all rules in one projection over one scan.

    The lower-case text is a column of its own, so it is made once per text.
    """
    texts = docs.select(*keys, text, folded(text).alias("__folded"))
    found = F.explode(rule_findings(rules, text, "__folded")).alias("f")
    return texts.select(*keys, found).select(*keys, "f.*")


def code_metrics(docs: DataFrame, text: str, keys) -> DataFrame:
    """Lines, blank lines, comment lines and counts of definition words."""
    normal = docs.select(*keys, text, normal_breaks(text).alias("__normal"))
    return normal.select(
        *keys,
        line_count("__normal").alias("lines_of_code"),
        F.regexp_count("__normal", F.lit(rf"(?dmU)^{BLANKS}*$")).cast("bigint").alias("blank_lines"),
        F.regexp_count("__normal", F.lit(rf"(?dmU)^{BLANKS}*#")).cast("bigint").alias("comment_lines"),
        count_occurrences(text, "def ").alias("functions_count"),
        count_occurrences(text, "class ").alias("classes_count"),
        (count_occurrences(text, "import ") + count_occurrences(text, "from ")).alias("imports_count"),
    )


def complexity(docs: DataFrame, text: str, keys) -> DataFrame:
    """Count of branching words and its class."""
    score = sum((count_occurrences(text, t) for t in COMPLEXITY_TOKENS[1:]), count_occurrences(text, COMPLEXITY_TOKENS[0]))
    scored = docs.select(*keys, score.alias("complexity_score"))
    return scored.withColumn(
        "complexity_estimate",
        F.when(F.col("complexity_score") > COMPLEXITY_MEDIUM, "high")
        .when(F.col("complexity_score") > COMPLEXITY_LOW, "medium")
        .otherwise("low"),
    )


def finding_level(strict: bool):
    """error, warning or suggestion: strict runs treat security findings as errors."""
    return (
        F.when(F.col("kind") == "syntax", "error")
        .when(F.col("kind") == "security", "error" if strict else "warning")
        .when(F.col("kind") == "performance", "suggestion")
        .otherwise(F.col("severity"))
    )


def route_findings(findings: DataFrame, strict: bool = False, key: str = "file_path") -> DataFrame:
    """Findings with their level; a file that does not parse keeps only its syntax finding.

    One window per file instead of an anti join, so costly findings (lint) are computed once; a file is limited in
    size, and so are its findings.
    """
    syntax = F.col("kind") == "syntax"
    broken = F.max(syntax).over(Window.partitionBy(key))
    return (
        findings.withColumn("__broken", broken)
        .where(~F.col("__broken") | syntax)
        .drop("__broken")
        .withColumn("level", finding_level(strict))
    )


def validate(files: DataFrame, findings: DataFrame, keys, strict: bool = False, skip_warnings: bool = False) -> DataFrame:
    """Per file: errors, warnings, suggestions and the pass flag; files and findings as two tables (see :func:`validate_checked`)."""
    none = files.select(*keys, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("severity"))
    return validate_checked(none.unionByName(findings.select(*keys, "kind", "severity")), keys, strict, skip_warnings)


def validate_checked(checked: DataFrame, keys, strict: bool = False, skip_warnings: bool = False) -> DataFrame:
    """Per file: errors, warnings, suggestions and the pass flag.

    ``checked`` has a row for every finding and one with a NULL kind for every file, so clean files stay in and one
    grouping with map-side sums is all. ``skip_warnings`` empties ``reported_warnings`` only; the counts and the pass
    flag do not change.
    """
    level = finding_level(strict)
    syntax = F.col("kind") == "syntax"

    def mark(condition):
        return F.coalesce(F.sum((F.col("kind").isNotNull() & condition).cast("bigint")), F.lit(0))

    sums = checked.groupBy(*keys).agg(
        mark(syntax).alias("s"), mark((level == "error") & ~syntax).alias("e"), mark(level == "warning").alias("w"), mark(level == "suggestion").alias("g"))
    broken = F.col("s") > 0
    counted = sums.select(
        *keys,
        (~broken).alias("syntax_valid"),
        F.when(broken, F.col("s")).otherwise(F.col("e")).alias("errors"),
        F.when(broken, F.lit(0)).otherwise(F.col("w")).cast("bigint").alias("warnings"),
        F.when(broken, F.lit(0)).otherwise(F.col("g")).cast("bigint").alias("suggestions"),
    )
    passed = F.col("errors") == 0
    if strict:
        passed = passed & (F.col("warnings") == 0)
    reported = F.lit(0).cast("bigint") if skip_warnings else F.col("warnings")
    return counted.withColumns({"reported_warnings": reported, "validation_passed": passed})


def validation_summary(per_file: DataFrame, by=(), strict: bool = False) -> DataFrame:
    """Totals, clamped quality score and overall status per group; ``legacy_status`` is always passed."""
    total = per_file.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("errors") > 0).alias("files_with_errors"),
        F.count_if(F.col("warnings") > 0).alias("files_with_warnings"),
        F.count_if("validation_passed").alias("files_passed"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("total_errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).cast("bigint").alias("total_warnings"),
        F.coalesce(F.sum("suggestions"), F.lit(0)).cast("bigint").alias("total_suggestions"),
    )
    raw = F.lit(BASE_SCORE) - F.col("total_errors") * ERROR_PENALTY - F.col("total_warnings") * WARNING_PENALTY
    warned = "failed" if strict else "warning"
    return total.withColumns({
        "overall_quality_score": F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("double"),
        "overall_status": F.when(F.col("total_errors") > 0, "failed").when(F.col("total_warnings") > 0, warned)
        .otherwise("passed"),
        "legacy_status": F.lit("passed"),
    })


def top_issues(routed: DataFrame, run, order, errors: int = 5, warnings: int = 3, warnings_if_clean: bool = False) -> DataFrame:
    """First errors and first warnings of each run; ``rank`` counts per run and level.

    ``warnings_if_clean`` drops the warnings of runs that also have errors.
    """
    wanted = routed.where(F.col("level").isin("error", "warning"))
    top = first_per_group(wanted, [*run, "level"], order, max(errors, warnings), rank="rank")
    top = top.where(F.col("rank") <= F.when(F.col("level") == "error", errors).otherwise(warnings))
    if not warnings_if_clean:
        return top
    failed = top.where(F.col("level") == "error").select(*run).distinct()
    return top.where(F.col("level") == "error").unionByName(
        top.where(F.col("level") == "warning").join(failed, list(run), "left_anti")
    )
