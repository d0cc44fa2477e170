"""Classification of request texts and the files they mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import as_col, contains_any, file_name, present

# Words that decide the class of a request, in the order they are tried.
REQUEST_CLASSES = {
    "migration": ["migrate", "convert", "replace", "upgrade"],
    "feature_addition": ["add", "implement", "create", "build"],
    "bug_fix": ["fix", "bug", "error", "issue"],
    "optimization": ["optimize", "improve", "performance"],
}
# Words looked for in a request.
TECHNOLOGIES = ["pandas", "pyspark", "numpy", "tensorflow", "pytorch", "flask", "django", "fastapi", "react", "vue",
                "angular", "spark", "hadoop"]
PRIORITY_WORDS = ["urgent", "critical", "important", "asap", "quickly", "slowly", "carefully"]
SCOPE_PHRASES = ["all files", "entire project", "specific file", "only", "just", "complete", "partial"]
ACTION_WORDS = ["migrate", "convert", "add", "remove", "update", "modify", "create", "delete"]

# Ways a request names a Python file, and what counts as a file name.
FILE_PATTERNS = [
    r"\b(\w+\.py)\b",
    r"""["']([^"']*\.py)["']""",
    r"""\bin\s+(?:the\s+)?["']?(\w+\.py)["']?""",
    r"""\bmodify\s+(?:the\s+)?["']?(\w+\.py)["']?""",
    r"""\bfile\s+["']?(\w+\.py)["']?""",
    r"""\bcreate\s+(?:the\s+)?["']?(\w+\.py)["']?""",
    r"""\bupdate\s+(?:the\s+)?["']?(\w+\.py)["']?""",
]
FILE_NAME = r"(?U)^[\w\-.]+\.py$"


def request_class(text) -> Column:
    lower = F.lower(F.coalesce(as_col(text), F.lit("")))
    out = F.lit("general")
    for name, group in reversed(REQUEST_CLASSES.items()):
        out = F.when(contains_any(lower, group), F.lit(name)).otherwise(out)
    return out


def classify_request(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("query_type", request_class(text))


def mentions(df: DataFrame, text: str) -> DataFrame:
    """Arrays of the technologies, priority words, scope phrases and actions a text contains."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({
        "technologies_mentioned": present(lower, TECHNOLOGIES),
        "priority_keywords": present(lower, PRIORITY_WORDS),
        "scope_indicators": present(lower, SCOPE_PHRASES),
        "action_words": present(lower, ACTION_WORDS),
    })


def mentioned_files(text) -> Column:
    """Distinct Python file names in a text."""
    found = [F.regexp_extract_all(as_col(text), F.lit("(?iU)" + p), F.lit(1)) for p in FILE_PATTERNS]
    names = F.array_distinct(F.concat(*found))
    return F.filter(names, lambda n: (F.length(n) > 3) & n.rlike(FILE_NAME))


def extract_files(df: DataFrame, text: str, keys) -> DataFrame:
    """One row per text and mentioned file."""
    return df.select(*keys, F.explode(mentioned_files(text)).alias("file_name"))


def missing_in_context(df: DataFrame, text: str, context: str, keys) -> DataFrame:
    """Mentioned files whose name does not occur in the context text, in any case."""
    absent = F.filter(mentioned_files(text), lambda n: ~F.contains(F.lower(F.col(context)), F.lower(n)))
    return df.select(*keys, F.explode(absent).alias("file_name"))


def missing_mentions(mentioned: DataFrame, planned: DataFrame, keys, path: str = "file_path") -> DataFrame:
    """Mentioned files that no planned file of the same request has as its name."""
    names = planned.select(*keys, file_name(path).alias("file_name"))
    return mentioned.join(names, [*keys, "file_name"], "left_anti")
