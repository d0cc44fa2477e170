"""Status of a run from its state flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(c) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def status_rules() -> list[tuple[Column, str, str]]:
    """(condition, status, stage) in the order they are tried."""
    suggested = F.size(F.coalesce("suggestions", F.array().cast("array<string>"))) > 0
    planned, rejected = _set("master_planner_success"), F.col("master_planner_approved") == F.lit(False)
    validated = _set("has_validator_result")
    summarised = _set("has_validation_summary")
    passed = _set("code_validator_success")
    # Statuses and stages.
    return [
        (planned & F.col("master_planner_approved").isNull(), "waiting_for_input", "master_planner_approval"),
        (F.coalesce(rejected, F.lit(False)), "restarting", "restarting_after_rejection"),
        (~_set("is_satisfied") & _set("enhancement_success") & suggested, "query_refinement_needed", "query_refinement"),
        (~_set("communication_success"), "communication_failed", "communication_failed"),
        (~_set("enhancement_success"), "enhancement_failed", "enhancement_failed"),
        (~passed & validated & ~summarised, "error", "validation_error"),
        (~passed & validated, "validation_failed", "validation_feedback"),
        (passed & validated & ~summarised, "error", "validation_summary_error"),
        (passed & validated, "completed", "completed"),
        (_set("delta_analyzer_success"), "processing", "code_generation"),
        (planned, "processing", "delta_analysis"),
    ]


def derive_status(state: DataFrame) -> DataFrame:
    """Add ``status`` and ``workflow_stage``."""
    status, stage = F.lit("processing"), F.lit("master_planning")
    for condition, s, w in reversed(status_rules()):
        status = F.when(condition, F.lit(s)).otherwise(status)
        stage = F.when(condition, F.lit(w)).otherwise(stage)
    return state.withColumns({"status": status, "workflow_stage": stage})


def status_counts(state: DataFrame) -> DataFrame:
    return derive_status(state).groupBy("status", "workflow_stage").agg(F.count(F.lit(1)).alias("sessions"))
