"""Validation of source files in one read, and the run of a change plan from edits to the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.text import folded
from corpuscope.operators.edits import apply_edits, most_edits
from corpuscope.operators.quality import PERFORMANCE, SECURITY, rule_findings, validate_checked, validation_summary
from corpuscope.operators.symbols import parsed, tree_findings
from corpuscope.session import staged
from corpuscope.sources.ledger import append_ledger

FINDING = ["rule_id", "kind", "severity", "message"]
FOUND = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in FINDING]))


def all_findings(texts: DataFrame, keys, rules=tuple(SECURITY + PERFORMANCE), content: str = "content", lint: bool = True) -> DataFrame:
    """``*keys, found``: the findings of the rules and of the parse of each text as one array, in one read.

    The rules are columns beside the text. Texts are dealt by their key over all shuffle partitions before the parse, as a
    parse costs far more than its bytes, and before the rules, as findings are longer than many a text.
    """
    dealt = texts.select(*keys, F.col(content).alias("__text"))
    if lint:
        dealt = dealt.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    ruled = dealt.select(*keys, "__text", folded("__text").alias("__folded"))
    ruled = ruled.select(*keys, "__text", rule_findings(rules, "__text", "__folded").alias("found"))
    if not lint:
        return ruled.select(*keys, "found")
    parsed_once = ruled.select(*keys, "found", parsed("__text").alias("__tree"))
    of_tree = F.transform(tree_findings("__tree"), lambda f: F.struct(*[f[c].alias(c) for c in FINDING]))
    return parsed_once.select(*keys, F.concat("found", of_tree).alias("found"))


def finding_rows(found: DataFrame, columns) -> DataFrame:
    """A row for each finding and one with NULL in its columns for each row of ``found``."""
    none = F.array(F.lit(None).cast(FOUND.elementType))
    rows = found.select(*columns, F.explode(F.concat(none, F.coalesce("found", F.array().cast(FOUND)))).alias("f"))
    return rows.select(*columns, *[F.col(f"f.{c}") for c in FINDING])


def check_files(files: DataFrame, rules=tuple(SECURITY + PERFORMANCE), keys=("file_path",), content: str = "content", lint: bool = True) -> DataFrame:
    """One row per file, with NULL in the columns of a finding, and one per finding of the rules and of the parse."""
    return finding_rows(all_findings(files, keys, rules, content, lint), keys)


def run_changes(files: DataFrame, edits: DataFrame, run: str = "run_id", key: str = "file_path", content: str = "content",
                rules=tuple(SECURITY + PERFORMANCE), strict: bool = False, lint: bool = True) -> DataFrame:
    """A change plan from its edits to the outcome of each run.

    ``files``: run, key, content; ``edits`` as for ``apply_edits``. The edits are applied once and kept, the resulting texts
    checked, the findings summed per file and per run, and the outcome kept for the ledger and whoever else reads it.
    ``files_not_edited`` counts files whose edits could not be applied; a run passes
    without those and without errors. Edits without a document belong to no run and are left to ``apply_edits``.
    """
    done = staged(apply_edits(files, edits, key, content, keep=[run], missing=False, most=most_edits(edits, key)), "edited")
    usable = F.col("status").isin("edited", "unchanged")
    checked = check_files(done.where(usable), rules, [run, key], content, lint)
    per_file = validate_checked(checked, [run, key], strict)
    summary = validation_summary(per_file, [run], strict)
    counts = done.groupBy(F.col(run).alias("__run")).agg(
        F.count_if(F.col("status") == "edited").alias("files_edited"), F.count_if(~usable).alias("files_not_edited"))
    joined = counts.join(summary, F.col("__run").eqNullSafe(F.col(run)), "left")
    whole = joined.select(F.col("__run").alias(run), "files_edited", "files_not_edited", *[c for c in summary.columns if c != run])
    passed = (F.col("files_not_edited") == 0) & (F.coalesce("overall_status", F.lit("passed")) != "failed")
    return staged(whole.withColumn("passed", passed), "runs")


def record_passed(runs: DataFrame, path: str, saved_at, run: str = "run_id") -> None:
    """Ledger entries of the runs that passed, one folder per run."""
    append_ledger(runs.withColumn("saved_at", saved_at), path, user=run, passed="passed")
