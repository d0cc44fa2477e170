"""Registered API-catalog queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.markup import clean_markup
from corpuscope.operators.catalog import (
    analyze_files,
    call_candidates,
    catalog_names,
    extract_calls,
    file_changes,
    has_import,
    insert_ignore,
    is_significant,
    mine_version_info,
    resolve_calls,
)
from corpuscope.operators.topk import first_per_group
from corpuscope.session import shared_dir
from corpuscope.sources.catalog import CATALOG_COLUMNS, catalog_dims, read_api_catalog, write_api_catalog
from workload.tables import CTES, SPACES, api_docs, source_files, sql, table


def api_rows(spark, sf):
    """Catalog rows of every part, before names are made unique."""
    rows = mine_version_info(api_docs(spark, sf)).withColumns({
        "pyspark_version": F.lit("3.5.0"),
        "parameters": F.concat(F.lit("(self, size="), "p_size", F.lit(")")),
        "returns": F.lit(""),
    })
    return rows.select("p_partkey", *CATALOG_COLUMNS)


def catalog(spark, sf):
    return first_per_group(api_rows(spark, sf), ["qualname"], ["p_partkey"], 1).drop("p_partkey")


def version_info(spark, sf):
    return mine_version_info(api_docs(spark, sf)).select(
        "p_partkey", "versionadded", "versionchanged", "versionchanged_note", "deprecated_in", "deprecated_note",
        "replacement", "deprecated")


VERSION_INFO = sql("""
    SELECT p_partkey, versionadded, versionchanged, versionchanged_note, deprecated_in, deprecated_note, replacement, deprecated
    FROM mined
""")


def catalog_csv(spark, sf):
    """Catalog written as CSV and read back."""
    path = shared_dir(spark, "catalog")
    write_api_catalog(catalog(spark, sf).withColumn("deprecated", F.initcap(F.col("deprecated").cast("string"))), path)
    return read_api_catalog(spark, path)


CATALOG_CSV = sql("""
    SELECT '3.5.0' AS pyspark_version, module, qualname, type, '(self, size=' || p_size || ')' AS parameters, '' AS returns,
           deprecated, versionadded, versionchanged, versionchanged_note, deprecated_in, deprecated_note, replacement,
           docstring
    FROM catalog
""")


def catalog_insert(spark, sf):
    """New catalog rows added to those of the small parts; existing names win."""
    rows = api_rows(spark, sf)
    existing = first_per_group(rows.where(F.col("type") == "function"), ["qualname"], [F.desc("p_partkey")], 1)
    return insert_ignore(existing, rows, ["qualname"], ["p_partkey"]).select("p_partkey", "qualname", "type", "docstring")


CATALOG_INSERT = sql("""
    WITH existing AS (
        SELECT p_partkey, qualname, type, docstring FROM (
            SELECT *, row_number() OVER (PARTITION BY qualname ORDER BY p_partkey DESC) AS n FROM mined WHERE type = 'function')
        WHERE n = 1)
    SELECT * FROM existing
    UNION ALL
    SELECT p_partkey, qualname, type, docstring FROM catalog WHERE qualname NOT IN (SELECT qualname FROM existing)
""")


def order_insert(spark, sf):
    """One order per customer and priority: large orders are there already, of the others the first one comes in."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    large = orders.where(F.col("o_totalprice") > 250000)
    existing = first_per_group(large, ["o_custkey", "o_orderpriority"], ["o_orderkey"], 1)
    return insert_ignore(existing, orders, ["o_custkey", "o_orderpriority"], ["o_orderkey"])


ORDER_INSERT = """
    WITH existing AS (
        SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n
            FROM orders WHERE o_totalprice > 250000) WHERE n = 1)
    SELECT * FROM existing
    UNION ALL
    SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.o_custkey = o.o_custkey AND e.o_orderpriority = o.o_orderpriority))
    WHERE n = 1
"""


def catalog_dimensions(spark, sf):
    return catalog_dims(catalog(spark, sf))


CATALOG_DIMENSIONS = sql("""
    SELECT DISTINCT 'module' AS kind, module AS name FROM catalog
    UNION ALL
    SELECT DISTINCT 'class', list_extract(string_split(qualname, '.'), -2) FROM catalog
    WHERE len(string_split(qualname, '.')) > 2
""")


def cleaned_notes(spark, sf):
    docs = api_docs(spark, sf)
    return docs.select("p_partkey", clean_markup("docstring").alias("cleaned"))


CLEANED_NOTES = sql(rf"""
    SELECT p_partkey, trim(replace(regexp_replace(docstring, ':\w+:`([^`]+)`', '\1', 'g'), '``', ''), {SPACES}) AS cleaned
    FROM api_docs
""")


def import_flags(spark, sf):
    return source_files(spark, sf).select("file_path", has_import("content").alias("has_pyspark"))


IMPORT_FLAGS = sql(r"""
    SELECT file_path, regexp_matches(content, 'import\s+pyspark|from\s+pyspark') AS has_pyspark FROM source_files
""")


def file_calls(spark, sf):
    return extract_calls(source_files(spark, sf))


CTES["calls"] = r"""
    SELECT file_path, (generate_subscripts(found, 1) - 1)::BIGINT AS pos, unnest(found) AS call
    FROM (SELECT file_path, regexp_extract_all(content, '\b(?:pyspark(?:\.\w+)+|\w+\.\w+)\b') AS found FROM source_files)
"""
FILE_CALLS = sql("SELECT * FROM calls")


def resolved_calls(spark, sf):
    return resolve_calls(extract_calls(source_files(spark, sf)), catalog(spark, sf), significant_only=False)


CTES["dims"] = """
    SELECT DISTINCT module, cls FROM (SELECT DISTINCT module FROM catalog), (
        SELECT '' AS cls UNION SELECT '.' || list_extract(string_split(qualname, '.'), -2) FROM catalog
        WHERE len(string_split(qualname, '.')) > 2)
"""
# The check builds every module × class name, as a plain reading of the rule does.
CTES["named"] = """
    SELECT c.*, split_part(qualname, '.', -1) AS last, EXISTS (
        SELECT 1 FROM dims WHERE qualname = module || cls || '.' || split_part(c.qualname, '.', -1)) AS resolvable
    FROM (SELECT p_partkey, p_size, qualname, docstring, versionchanged, versionchanged_note, deprecated, deprecated_in, deprecated_note
          FROM catalog) c
"""
CTES["matches"] = """
    SELECT DISTINCT file_path, qualname FROM (
        SELECT file_path, call, min(qualname) AS qualname FROM calls JOIN named ON split_part(call, '.', -1) = last
        WHERE CASE WHEN starts_with(call, 'pyspark.') THEN call = qualname ELSE resolvable END
        GROUP BY file_path, call)
"""
RESOLVED_CALLS = sql("SELECT * FROM matches")


def first_matches(spark, sf):
    """Names that calls of files with the import mean, with the number of files."""
    files = source_files(spark, sf).where(has_import("content"))
    found = resolve_calls(extract_calls(files), catalog(spark, sf), significant_only=False)
    return found.groupBy("qualname").agg(F.count(F.lit(1)).alias("n_files"))


FIRST_MATCHES = sql(r"""
    SELECT qualname, count(*) AS n_files FROM matches WHERE file_path IN (
        SELECT file_path FROM source_files WHERE regexp_matches(content, 'import\s+pyspark|from\s+pyspark')) GROUP BY qualname
""")


def candidates(spark, sf):
    return call_candidates(extract_calls(source_files(spark, sf)), catalog(spark, sf))


CANDIDATES = sql("""
    SELECT DISTINCT CASE WHEN starts_with(call, 'pyspark.') THEN call ELSE '.' || last END AS lookup, qualname
    FROM (SELECT DISTINCT call FROM calls) JOIN named ON split_part(call, '.', -1) = last
    WHERE CASE WHEN starts_with(call, 'pyspark.') THEN call = qualname ELSE resolvable END
""")


def significant_names(spark, sf):
    return catalog(spark, sf).where(is_significant()).select("qualname", "deprecated")


PHRASES = ["deprecated", "use ", "replaced by", "will be removed", "alias for", "moved to"]


def has_phrase(column):
    return "(" + " OR ".join(f"contains(lower(trim({column}, {SPACES})), '{p}')" for p in PHRASES) + ")"


SIGNIFICANT = f"(deprecated OR {has_phrase('deprecated_note')} OR {has_phrase('versionchanged_note')} OR {has_phrase('docstring')})"
SIGNIFICANT_NAMES = sql(f"SELECT qualname, deprecated FROM catalog WHERE {SIGNIFICANT}")

CTES["reported"] = rf"""
    SELECT file_path, m.qualname AS function_name,
           CASE WHEN deprecated THEN 'Deprecated in Pyspark ' || deprecated_in
                WHEN versionchanged <> '' THEN 'Changed in Pyspark ' || versionchanged ELSE '' END AS reason,
           CASE WHEN deprecated THEN deprecated_note
                WHEN versionchanged <> '' THEN trim(replace(regexp_replace(versionchanged_note, ':\w+:`([^`]+)`', '\1', 'g'), '``', ''), {SPACES})
           END AS suggestion,
           deprecated, '(self, size=' || p_size || ')' AS parameter, docstring AS summary
    FROM matches m JOIN named n ON n.qualname = m.qualname WHERE {SIGNIFICANT}
"""


def call_changes(spark, sf):
    return file_changes(source_files(spark, sf), catalog(spark, sf))


CALL_CHANGES = sql(r"""
    SELECT * FROM reported WHERE file_path IN (
        SELECT file_path FROM source_files WHERE regexp_matches(content, 'import\s+pyspark|from\s+pyspark'))
""")


def migration_report(spark, sf):
    report = analyze_files(source_files(spark, sf), catalog(spark, sf))
    return report.select(
        "file_path", "has_pyspark", "aligned_with_3_5", "needs_modification",
        "n_changes", F.array_join("functions", "|").alias("functions"),
    )


MIGRATION_REPORT = sql(r"""
    WITH flagged AS (SELECT file_path, regexp_matches(content, 'import\s+pyspark|from\s+pyspark') AS has_pyspark FROM source_files),
    listed AS (SELECT file_path, count(*) AS n, string_agg(function_name, '|' ORDER BY function_name) AS functions FROM reported
               WHERE file_path IN (SELECT file_path FROM flagged WHERE has_pyspark) GROUP BY file_path)
    SELECT f.file_path, has_pyspark, n IS NULL AS aligned_with_3_5, n IS NOT NULL AS needs_modification,
           coalesce(n, 0) AS n_changes, coalesce(functions, '') AS functions
    FROM flagged f LEFT JOIN listed l ON l.file_path = f.file_path
""")


def resolvable_names(spark, sf):
    return catalog_names(catalog(spark, sf)).select("qualname", "resolvable")


RESOLVABLE_NAMES = sql("SELECT qualname, resolvable FROM named")

QUERIES = {
    "version_info": (version_info, VERSION_INFO),
    "catalog_csv": (catalog_csv, CATALOG_CSV),
    "catalog_insert": (catalog_insert, CATALOG_INSERT),
    "order_insert": (order_insert, ORDER_INSERT),
    "catalog_dims": (catalog_dimensions, CATALOG_DIMENSIONS),
    "clean_markup": (cleaned_notes, CLEANED_NOTES),
    "import_flags": (import_flags, IMPORT_FLAGS),
    "extract_calls": (file_calls, FILE_CALLS),
    "catalog_names": (resolvable_names, RESOLVABLE_NAMES),
    "resolve_calls": (resolved_calls, RESOLVED_CALLS),
    "call_candidates": (candidates, CANDIDATES),
    "first_match_calls": (first_matches, FIRST_MATCHES),
    "significant_names": (significant_names, SIGNIFICANT_NAMES),
    "change_report": (call_changes, CALL_CHANGES),
    "migration_report": (migration_report, MIGRATION_REPORT),
}
