"""API-catalog mining and migration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.markup import clean_markup, is_deprecated, version_info
from corpuscope.functions.text import contains_any, strip
from corpuscope.operators.topk import first_per_group

# Import test, call pattern, phrases and texts of the report.
IMPORT_PATTERN = r"(?U)import\s+pyspark|from\s+pyspark"
CALL_PATTERN = r"(?U)\b(?:pyspark(?:\.\w+)+|\w+\.\w+)\b"
ABSOLUTE_PREFIX = "pyspark."
SIGNIFICANT_PHRASES = ["deprecated", "use ", "replaced by", "will be removed", "alias for", "moved to"]
DEFAULT_DEPRECATED_IN = "3.5"
DEFAULT_PARAMETERS = "passing parameters"


def mine_version_info(df: DataFrame, doc: str = "docstring", qualname: str = "qualname") -> DataFrame:
    """Add the version columns mined from the docstring and the deprecated flag."""
    short = F.element_at(F.split(qualname, r"\."), -1)
    return df.withColumns({**version_info(doc), "deprecated": is_deprecated(short, doc)})


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys, order) -> DataFrame:
    """Existing rows plus incoming rows with new keys; the first incoming row of a key wins."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(first_per_group(fresh, keys, order, 1).select(*existing.columns))


def has_import(content) -> Column:
    return F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")).rlike(IMPORT_PATTERN)


def extract_calls(files: DataFrame, content: str = "content", key: str = "file_path") -> DataFrame:
    """Dotted names in the text, in order of appearance."""
    found = F.regexp_extract_all(F.col(content), F.lit(CALL_PATTERN), F.lit(0))
    return files.select(key, F.posexplode(found).alias("pos", "call")).withColumn("pos", F.col("pos").cast("bigint"))


def is_significant() -> Column:
    """Deprecated, or a tell-tale phrase in a note or the docstring."""
    def phrase(c):
        return contains_any(F.lower(strip(F.coalesce(F.col(c), F.lit("")))), SIGNIFICANT_PHRASES)

    flag = F.coalesce(F.col("deprecated"), F.lit(False))
    return flag | phrase("deprecated_note") | phrase("versionchanged_note") | phrase("docstring")


def catalog_names(catalog: DataFrame) -> DataFrame:
    """Narrow lookup: qualified name, last part, whether a relative call can mean it, significance.

    A relative call ``x.m`` may mean ``module.m`` or ``module.class.m`` for any known module and class. Instead of
    building modules × classes names per call, each catalog row is tested once: its owner, or the owner's owner,
    has to be a known module (the class between them is known by that very row).
    """
    name = strip("qualname")
    parts = F.split(name, r"\.")

    def front(dropped):
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dropped, F.lit(0))), ".")

    named = catalog.select(
        name.alias("qualname"),
        F.element_at(parts, -1).alias("last"),
        front(1).alias("owner"),
        F.when(F.size(parts) > 2, front(2)).alias("outer"),
        is_significant().alias("significant"),
    )
    modules = catalog.select(strip("module").alias("module")).distinct()
    direct = modules.select(F.col("module").alias("owner"), F.lit(True).alias("__direct"))
    nested = modules.select(F.col("module").alias("outer"), F.lit(True).alias("__nested"))
    return (
        named.join(direct, "owner", "left")
        .join(nested, "outer", "left")
        .select(
            "qualname", "last", "significant",
            (F.coalesce("__direct", F.lit(False)) | F.coalesce("__nested", F.lit(False))).alias("resolvable"),
        )
    )


def call_lookup(catalog: DataFrame, significant_only: bool = True, all_matches: bool = False) -> DataFrame:
    """``(lookup, qualname)``: absolute names by themselves, relative ones by ``.last``.

    A relative call stands for one name, the smallest it can mean; whether that one is significant is asked afterwards.
    With ``all_matches`` it stands for every name it can mean.
    """
    names = catalog_names(catalog)
    relative = names.where(F.col("resolvable")).select(F.concat(F.lit("."), "last").alias("lookup"), "qualname", "significant")
    if not all_matches:
        relative = relative.groupBy("lookup").agg(F.min(F.struct("qualname", "significant")).alias("first")).select("lookup", "first.*")
    found = relative.unionByName(names.select(F.col("qualname").alias("lookup"), "qualname", "significant"))
    return (found.where(F.col("significant")) if significant_only else found).select("lookup", "qualname")


def _lookup_key(call: str) -> Column:
    last = F.concat(F.lit("."), F.substring_index(call, ".", -1))
    return F.when(F.startswith(F.col(call), F.lit(ABSOLUTE_PREFIX)), F.col(call)).otherwise(last)


def resolve_calls(calls: DataFrame, catalog: DataFrame, significant_only: bool = True, key: str = "file_path") -> DataFrame:
    """Catalog names that each file's calls mean: one row per file and name, never more than its distinct calls.

    One equi-join on the lookup key; the lookup has one row per key, so a hot method name is on one side only, where
    the adaptive skew join can split it. A file's rows lie together, so most duplicates go before the exchange.
    """
    wanted = calls.select(key, _lookup_key("call").alias("lookup"))
    return wanted.join(call_lookup(catalog, significant_only), "lookup").select(key, "qualname").distinct()


def call_candidates(calls: DataFrame, catalog: DataFrame, significant_only: bool = False) -> DataFrame:
    """All catalog names that a call can mean: one row per called name and catalog name, whatever the number of files."""
    wanted = calls.select(_lookup_key("call").alias("lookup")).distinct()
    return wanted.join(call_lookup(catalog, significant_only, all_matches=True), "lookup").distinct()


def change_details(catalog: DataFrame) -> DataFrame:
    """What a report says about each catalog name."""
    deprecated = F.coalesce(F.col("deprecated"), F.lit(False))
    changed = F.coalesce(F.col("versionchanged"), F.lit("")) != ""
    since = F.coalesce("deprecated_in", F.lit(DEFAULT_DEPRECATED_IN))
    return catalog.select(
        strip("qualname").alias("qualname"),
        F.when(deprecated, F.concat(F.lit("Deprecated in Pyspark "), since))
        .when(changed, F.concat(F.lit("Changed in Pyspark "), "versionchanged"))
        .otherwise(F.lit("")).alias("reason"),
        F.when(deprecated, F.col("deprecated_note")).when(changed, clean_markup("versionchanged_note")).alias("suggestion"),
        deprecated.alias("deprecated"),
        F.coalesce("parameters", F.lit(DEFAULT_PARAMETERS)).alias("parameter"),
        F.col("docstring").alias("summary"),
    )


def change_report(resolved: DataFrame, catalog: DataFrame, key: str = "file_path") -> DataFrame:
    """Reason and suggestion for every resolved name."""
    return resolved.join(change_details(catalog), "qualname").select(
        key, F.col("qualname").alias("function_name"), "reason", "suggestion", "deprecated", "parameter", "summary"
    )


def file_changes(files: DataFrame, catalog: DataFrame, content: str = "content", key: str = "file_path") -> DataFrame:
    """Change rows of the files that have the import; a file without it needs no change."""
    flagged = files.where(has_import(content))
    return change_report(resolve_calls(extract_calls(flagged, content, key), catalog, key=key), catalog, key)


def analyze_files(files: DataFrame, catalog: DataFrame, content: str = "content", key: str = "file_path") -> DataFrame:
    """Per file: import flag, alignment, need of change, number and names of the changes (rows: :func:`file_changes`).

    The files are read once: each gives its distinct calls, or a single row without one, and the join keeps every
    row, so the only exchange is the grouping by file. Only names are gathered, at most one per distinct call.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(CALL_PATTERN), F.lit(0)))
    flagged = files.select(key, content, has_import(content).alias("has_pyspark"))
    calls = flagged.select(key, "has_pyspark", F.explode_outer(F.when(F.col("has_pyspark"), found)).alias("call"))
    # Rows without a call get a key of their own file, so that a sorted join has no hot NULL key.
    own = F.concat(F.lit("?"), F.col(key))
    rows = calls.select(key, "has_pyspark", F.coalesce(_lookup_key("call"), own).alias("lookup")).join(
        call_lookup(catalog), "lookup", "left")
    listed = rows.groupBy(key).agg(F.max("has_pyspark").alias("has_pyspark"), F.sort_array(F.collect_set("qualname")).alias("functions"))
    n = F.size("functions").cast("bigint")
    return listed.select(key, "has_pyspark", (n == 0).alias("aligned_with_3_5"), (n > 0).alias("needs_modification"),
                         n.alias("n_changes"), "functions")
