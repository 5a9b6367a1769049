"""Grading of diagnostic queries, root-cause claims and whole responses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE_TYPE = "diagnostic_sql string, root_cause string, extraction_request string"
CAUSE_TYPE = "`table` string, `columns` array<string>, `transformation` string, `reason` string"


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Response text to columns; text without a readable object gives NULLs.

    The object runs from the first to the last brace. The root cause is read as raw text first,
    because some responses carry it as an object and some as a string holding one.
    """
    found = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)\{.*\}", 0)
    parsed = responses.withColumn("_answer", F.from_json(found, RESPONSE_TYPE)).withColumn(
        "_cause", F.from_json(F.col("_answer.root_cause"), CAUSE_TYPE)
    )
    readable = F.col("_answer.diagnostic_sql").isNotNull() | F.col("_answer.root_cause").isNotNull()
    return parsed.select(
        *responses.columns,
        readable.alias("readable"),
        F.col("_answer.diagnostic_sql").alias("diagnostic_sql"),
        F.col("_cause.table").alias("claimed_table"),
        F.col("_cause.columns").alias("claimed_columns"),
        F.col("_cause.transformation").alias("claimed_transformation"),
        F.col("_cause.reason").alias("claimed_reason"),
        F.col("_answer.extraction_request").alias("extraction_request"),
    )


def grade_localization(claims: DataFrame) -> DataFrame:
    """Compare claimed table and columns with ``final_table`` and ``defect_columns``.

    Correct means the right table and, among the claimed columns, the primary one (the first).
    """
    claimed = F.transform(F.coalesce(F.col("claimed_columns"), F.array().cast("array<string>")), F.lower)
    truth = F.transform(F.col("defect_columns"), F.lower)
    table_ok = F.coalesce(F.lower(F.trim("claimed_table")) == F.lower("final_table"), F.lit(False))
    primary_ok = F.coalesce(F.array_contains(claimed, F.get(truth, 0)), F.lit(False))
    overlap = F.array_sort(F.array_intersect(truth, claimed))
    return claims.withColumns(
        {
            "table_ok": table_ok,
            "columns_ok": F.size(overlap) > 0,
            "primary_ok": primary_ok,
            "overlap": overlap,
            "loc": table_ok & (F.size(overlap) > 0) & primary_ok,
        }
    )


def success() -> Column:
    return F.col("valid") & F.col("catch") & ~F.col("fp") & F.col("loc")


@dataclass(frozen=True)
class Candidate:
    """A query text to be run against the working tables of one defect."""

    group: str
    name: str
    sql: str


class Sandbox:
    """An isolated catalogue holding the working tables of one side.

    A candidate becomes a subquery of a SELECT, so it can only read. Arithmetic faults give NULL
    instead of stopping the job, as in the dialect the candidates were written for.
    """

    def __init__(self, spark: SparkSession):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.ansi.enabled", "false")
        self.session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))

    def register(self, frames: Mapping[str, DataFrame]) -> None:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)

    def plan(self, sql: str) -> DataFrame:
        """The query with its output columns named by position, as they may share a name; refused ones raise."""
        frame = self.session.sql(f"SELECT * FROM (\n{sql}\n) candidate")
        return frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])

    def run(self, sql: str) -> DataFrame:
        """The first output column as text; a query the analyser refuses raises."""
        return first_column(self.plan(sql))


def first_column(planned: DataFrame) -> DataFrame:
    return planned.select(F.col("c0").cast("string").alias("pk"))


def row_count(planned: DataFrame) -> DataFrame:
    """How many rows a query gives. Every column of every row is computed, so that a fault in any shows."""
    whole = F.length(F.struct(*planned.columns).cast("string")).cast("bigint")
    return planned.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(whole), F.lit(0)).alias("n_chars"))


def run_candidates(
    spark: SparkSession, sandbox: Sandbox, side: str, candidates: Iterable[Candidate]
) -> tuple[list[DataFrame | None], list[tuple[str, str, str, str]]]:
    """For each candidate its tagged plan, None if it cannot run, and (group, name, side, error).

    The loop runs over query texts, not over data; nothing is executed here.
    """
    plans, outcome = [], []
    for c in candidates:
        try:
            hits = sandbox.run(c.sql).select(
                F.lit(c.group).alias("defect_id"), F.lit(c.name).alias("candidate"),
                F.lit(side).alias("side"), "pk",
            )
            plans.append(hits)
            outcome.append((c.group, c.name, side, ""))
        except PySparkException as error:
            plans.append(None)
            outcome.append((c.group, c.name, side, error_name(error)))
    return plans, outcome


def error_name(error: PySparkException | Py4JJavaError) -> str:
    """The error's condition, or its class where it has none."""
    named = error.getCondition() if isinstance(error, PySparkException) else None
    found = re.search(r"\[([A-Z][A-Z_.]+)\]", str(error))
    return named or (found[1] if found else type(error).__name__)


def executed(
    plans: list[tuple[int, DataFrame]], write: Callable[[list[DataFrame]], DataFrame]
) -> tuple[list[DataFrame], dict[int, str]]:
    """Written hits of all numbered plans, and the errors of those that failed while they ran.

    All run as one job. If it fails, each half runs by itself, down to the plan that fails alone.
    """
    try:
        return [write([plan for _, plan in plans])], {}
    except (PySparkException, Py4JJavaError) as error:
        if len(plans) == 1:
            return [], {plans[0][0]: error_name(error)}
    middle = len(plans) // 2
    written, errors = executed(plans[:middle], write)
    more, others = executed(plans[middle:], write)
    return written + more, errors | others


OUTCOME_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("defect_id", "candidate", "side", "error")]
)


#: What is kept of the keys a run returned.
SUMMARY_TYPE = "planted_pk string, n_keys bigint, n_rows bigint"


def hit_summary(hits: DataFrame, planted: DataFrame) -> DataFrame:
    """What the verdicts need of the keys returned, a few rows a run: (defect_id, candidate, side, planted_pk, n_keys, n_rows).

    Distinct keys that are not null and rows, apart for each planted key that was returned (``planted_pk``) and
    together for all others (null). Of the clean side only rows are told, and its keys are not shuffled.
    """
    key = ["defect_id", "candidate", "side"]
    # A few keys per (defect, seed).
    known = F.broadcast(planted.select("defect_id", F.col("flagged_pk").alias("planted_pk")).distinct())
    own = hits.select(*key, F.when(F.col("side") == "trap", F.col("pk")).alias("pk"))
    by_key = own.groupBy(*key, "pk").agg(F.count("*").alias("n")).withColumnRenamed("defect_id", "_defect")
    met = by_key.join(known, (F.col("_defect") == F.col("defect_id")) & (F.col("pk") == F.col("planted_pk")), "left")
    return met.groupBy(F.col("_defect").alias("defect_id"), "candidate", "side", "planted_pk").agg(
        F.count("pk").alias("n_keys"), F.sum("n").alias("n_rows"))


def grade_checks(hits: DataFrame, outcomes: DataFrame, planted: DataFrame) -> DataFrame:
    """One verdict per (defect, candidate, seed).

    ``hits``: keys a candidate returned on the trap and the clean side, in full. ``planted``: a
    few keys per (defect, seed). A candidate catches when it returns a
    planted key on the trap side, and is precise when it also returns nothing on the clean side.
    """
    return grade_summaries(hit_summary(hits, planted), outcomes, planted)


def grade_summaries(summaries: DataFrame, outcomes: DataFrame, planted: DataFrame) -> DataFrame:
    """The same from the summaries of the keys returned."""
    key = ["defect_id", "candidate"]
    trap = summaries.filter(F.col("side") == "trap")
    counted = summaries.groupBy(*key).agg(
        F.sum(F.when(F.col("side") == "trap", F.col("n_keys"))).alias("n_caught"),
        F.sum(F.when(F.col("side") == "clean", F.col("n_rows"))).alias("n_clean"))
    planted_hits = (
        trap.join(
            planted.select("defect_id", "seed", F.col("flagged_pk").alias("planted_pk")),
            ["defect_id", "planted_pk"],
        )
        .groupBy(*key, "seed").agg(F.countDistinct("planted_pk").alias("n_planted_hit"))
    )
    ran = outcomes.groupBy(*key).agg(
        F.min(F.when(F.col("side") == "trap", F.col("error"))).alias("error"),
        F.min(F.when(F.col("side") == "clean", F.col("error"))).alias("clean_error"),
    )
    seeds = planted.select("defect_id", "seed").distinct()
    valid = F.col("error") == ""
    catch = F.col("n_planted_hit") > 0
    fp = valid & ((F.col("n_clean") > 0) | (F.col("clean_error") != ""))
    return (
        ran.join(seeds, "defect_id")
        .join(counted, key, "left").join(planted_hits, [*key, "seed"], "left")
        .na.fill(0, ["n_caught", "n_clean", "n_planted_hit"])
        .withColumns({"valid": valid, "catch": catch, "fp": fp})
        .withColumn("precise", F.col("catch") & ~F.col("fp"))
        .select(*key, "seed", "valid", "catch", "fp", "precise", "n_caught", "n_clean", "error")
    )
