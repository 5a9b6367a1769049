"""Reconciliation of reporting pipelines on Spark."""

from recon.operators.grading import grade_checks, grade_localization, parse_responses
from recon.operators.reconcile import (
    diff, diff_wide, missing_rows, repeated_keys, row_mismatch, schema_catalog, schema_diff,
)
from recon.operators.scoring import best_of_n, metrics_summary, reward
from recon.plans.defects import DEFECTS, DEFECTS_BY_ID, defects_for_pipeline
from recon.plans.reports import PIPELINES, get_pipeline
from recon.plans.spec import Defect, Pipeline, Step
from recon.plans.workbench import Workbench

__all__ = [
    "DEFECTS", "DEFECTS_BY_ID", "Defect", "PIPELINES", "Pipeline", "Step", "Workbench",
    "best_of_n", "defects_for_pipeline", "diff", "diff_wide", "get_pipeline", "grade_checks",
    "grade_localization", "metrics_summary", "missing_rows", "parse_responses", "repeated_keys",
    "reward", "row_mismatch", "schema_catalog", "schema_diff",
]
