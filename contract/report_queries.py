"""Queries over the reports: the clean tables, their traps, diffs and diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contract import sql_reports as sql
from contract.typed import typed
from recon.plans.defects import DEFECTS
from recon.plans.reports import PIPELINES
from recon.plans.spec import Defect
from recon.sources.tables import SourceTables

Query = Callable[[SparkSession, str], DataFrame]


def _clean(name: str) -> Query:
    return lambda spark, folder: typed(PIPELINES[name].report(SourceTables(spark, folder)))


def _trap(defect: Defect) -> Query:
    pipeline = PIPELINES[defect.pipeline_id]
    return lambda spark, folder: typed(defect.trap(pipeline, SourceTables(spark, folder)))


def diff_query(spark: SparkSession, folder: str, defect: Defect) -> DataFrame:
    pipeline, sources = PIPELINES[defect.pipeline_id], SourceTables(spark, folder)
    flagged = defect.diff(pipeline, defect.trap(pipeline, sources), pipeline.report(sources))
    return flagged.select(
        "flagged_pk", "side",
        flagged["reported"].cast("double").alias("reported"),
        flagged["expected"].cast("double").alias("expected"),
    )


def _diff(defect: Defect) -> Query:
    return lambda spark, folder: diff_query(spark, folder, defect)


def _gold(defect: Defect) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pipeline, sources = PIPELINES[defect.pipeline_id], SourceTables(spark, folder)
        return defect.gold(pipeline, defect.trap(pipeline, sources), pipeline.staging(sources))

    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _clean(name) for name in PIPELINES}
    for defect in DEFECTS:
        out[f"trap_{defect.defect_id}"] = _trap(defect)
        out[f"diff_{defect.defect_id}"] = _diff(defect)
        out[f"gold_{defect.defect_id}"] = _gold(defect)
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql.typed(sql.clean_sql(name), sql.COLUMNS[name]) for name in PIPELINES}
    for defect in DEFECTS:
        i = defect.defect_id
        out[f"trap_{i}"] = sql.typed(sql.trap_sql(i), sql.trap_columns(i))
        out[f"diff_{i}"] = sql.diff_sql(i)
        out[f"gold_{i}"] = sql.gold_sql(i)
    return out
