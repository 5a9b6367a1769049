"""Graded attempts: responses to episodes, their queries run in bulk, and the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.functions.text import sql_literal
from recon.operators import grading, scoring, screening
from recon.operators.grading import Sandbox
from recon.plans import runs
from recon.plans.defects import DEFECTS_BY_ID
from recon.plans.reports import PIPELINES
from recon.plans.workbench import Workbench, stacked

KINDS = ("gold", "junk", "empty", "broad", "wrong_table", "wrong_column")
# Which layer walk an attempt of each kind carries.
WALK_OF = {"gold": "gold", "wrong_table": "short", "wrong_column": "reversed"}


def responses(bench: Workbench) -> DataFrame:
    """Six response texts per episode: (defect_id, seed, attempt, kind, response)."""
    episodes = bench.suspects().join(F.broadcast(bench.defects), "defect_id")
    columns = F.col("defect_columns")
    others = F.when(F.size(columns) > 1, F.slice(columns, F.lit(2), F.size(columns))).otherwise(F.array(F.lit("unrelated")))
    extraction = F.concat(
        F.lit("SELECT * FROM "), F.col("final_table"), F.lit(" WHERE CAST("), F.col("pk"),
        F.lit(" AS STRING) IS NOT DISTINCT FROM "), sql_literal(F.col("flagged_pk")),
    )

    def cause(table, named):
        return F.struct(
            table.alias("table"), named.alias("columns"),
            F.col("description").alias("transformation"),
            F.lit("recomputation disagrees with the report").alias("reason"),
        )

    def answer(sql, root_cause):
        return F.to_json(
            F.struct(
                sql.alias("diagnostic_sql"), root_cause.alias("root_cause"),
                extraction.alias("extraction_request"),
            )
        )

    true_cause = cause(F.col("final_table"), columns)
    texts = (
        F.concat(F.lit("My findings:\n"), answer(F.col("gold_sql"), true_cause), F.lit("\nDone.")),
        F.concat(F.lit("no object here, only suspect "), F.col("flagged_pk")),
        F.lit('{"diagnostic_sql": "", "root_cause": {}}'),
        answer(F.col("broad_sql"), true_cause),
        answer(F.col("gold_sql"), F.to_json(cause(F.lit("another_table"), columns))),
        answer(F.col("gold_sql"), cause(F.col("final_table"), others)),
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("attempt"), F.lit(k).alias("kind"), t.alias("response"))
            for i, (k, t) in enumerate(zip(KINDS, texts))
        ]
    )
    return episodes.select("defect_id", "seed", F.explode(cells).alias("cell")).select(
        "defect_id", "seed", "cell.*"
    )


def parsed(bench: Workbench) -> DataFrame:
    """Responses as columns, with the query screened and named by its digest."""
    read = grading.parse_responses(responses(bench)).drop("response")
    named = read.withColumn("candidate", F.md5(F.coalesce("diagnostic_sql", F.lit("")).cast("binary")))
    return screening.screen_candidates(named, "diagnostic_sql")


def probes(bench: Workbench) -> DataFrame:
    """Queries every grader must see through: (defect_id, candidate, diagnostic_sql)."""
    final = F.col("final_table")
    texts = {
        "gold": F.col("gold_sql"),
        "broad": F.col("broad_sql"),
        "lookup": F.concat(F.lit("SELECT 'NONDIAG' AS probe FROM "), final, F.lit(" LIMIT 1")),
        "unknown column": F.concat(F.lit("SELECT no_such_column FROM "), final),
        "truth": F.lit("SELECT * FROM zz_truth"),
        "write": F.concat(F.lit("DROP TABLE "), final),
        "empty": F.lit(" "),
    }
    cells = F.array(
        *[F.struct(F.lit(n).alias("candidate"), t.alias("diagnostic_sql")) for n, t in texts.items()]
    )
    exploded = bench.defects.select("defect_id", F.explode(cells).alias("cell")).select(
        "defect_id", "cell.*"
    )
    return screening.screen_candidates(exploded, "diagnostic_sql")


class _Sides:
    """The trap and the clean catalogue, switched from defect to defect."""

    def __init__(self, bench: Workbench):
        self.bench = bench
        self.sandboxes = {side: Sandbox(bench.spark) for side in ("trap", "clean")}
        self.sources = {
            side: bench.sources.in_session(sandbox.session) for side, sandbox in self.sandboxes.items()
        }
        for side, sandbox in self.sandboxes.items():
            sandbox.register(self.sources[side])
        self._shown: dict[str, tuple[str, str]] = {}

    def open(self, side: str, defect_id: str) -> Sandbox:
        sandbox, bench = self.sandboxes[side], self.bench
        pipeline = PIPELINES[DEFECTS_BY_ID[defect_id].pipeline_id]
        shown = self._shown.get(side, ("", ""))
        if shown[0] != pipeline.pipeline_id:
            staging = pipeline.staging(self.sources[side])
            sandbox.register({s.name: staging[s.name] for s in pipeline.steps[:-1]})
        if shown[1] != defect_id:
            report = bench.trap(defect_id) if side == "trap" else bench.clean(pipeline.pipeline_id)
            path = bench.store.location(f"trap_{defect_id}" if side == "trap" else f"clean_{pipeline.pipeline_id}")
            sandbox.register(
                {pipeline.final_table: sandbox.session.read.schema(report.schema).parquet(path)}
            )
        self._shown[side] = (pipeline.pipeline_id, defect_id)
        return sandbox


def verdicts(bench: Workbench, candidates: DataFrame, name: str) -> DataFrame:
    """Grade every candidate against the planted keys, running each distinct plan once on both sides.

    Candidates that may not run are graded like one run whose outcome is the rule they break.
    """
    bench.write_reports()
    named = runs.named_texts(candidates, "diagnostic_sql")
    texts = named.filter("allowed").select("defect_id", "text_id", "sql")
    planted = bench.planted()
    ran = runs.PlanRuns(bench, _Sides(bench).open, name).execute(
        texts, grading.first_column, grading.SUMMARY_TYPE, lambda hits: grading.hit_summary(hits, planted))
    refused = named.filter("NOT allowed").select("defect_id", F.col("error").alias("candidate"), "error").distinct()
    outcomes = stacked([ran.outcomes(), *[refused.withColumn("side", F.lit(side)) for side in runs.SIDES]])
    found = ran.results(f"defect_id string, candidate string, side string, {grading.SUMMARY_TYPE}")
    graded_runs = grading.grade_summaries(found, outcomes, planted).withColumnRenamed("candidate", "run")
    mapped = named.select("defect_id", "candidate", "text_id", "allowed", "error").distinct().withColumnRenamed("error", "_rule")
    mapped = mapped.join(ran.mapping(), ["defect_id", "text_id"], "left").withColumn("run", F.when(F.col("allowed"), F.col("run")).otherwise(F.col("_rule")))
    return mapped.select("defect_id", "candidate", "run").join(graded_runs, ["defect_id", "run"]).drop("run")


EXTRACTION_TYPE = "defect_id string, candidate string, side string, n_rows bigint, n_chars bigint"


def extraction_runs(bench: Workbench, read: DataFrame) -> DataFrame:
    """Every distinct extraction request, executed on the trap: its rows, its error and whether it is useful.

    A request is useful when it may run and every row it asks for can be computed, be they none. Requests are
    screened like diagnostic queries, and those of one plan run once. (defect_id, extraction_request,
    extraction_rows, extraction_error, extraction_useful); blank requests are left out.
    """
    bench.write_reports(with_clean=False)  # requests see the trap side alone
    asked = read.filter(F.coalesce(F.trim("extraction_request"), F.lit("")) != "").select("defect_id", "extraction_request").distinct()
    named = runs.named_texts(screening.screen_candidates(asked, "extraction_request"), "extraction_request")
    texts = named.filter("allowed").select("defect_id", "text_id", "sql")
    ran = runs.PlanRuns(bench, _Sides(bench).open, "extraction", ("trap",)).execute(texts, grading.row_count, "n_rows bigint, n_chars bigint")
    outcomes = ran.outcomes().select("defect_id", F.col("candidate").alias("run"), F.col("error").alias("_error"))
    counts = ran.results(EXTRACTION_TYPE).select("defect_id", F.col("candidate").alias("run"), F.col("n_rows").alias("extraction_rows"))
    of_run = ran.mapping().join(outcomes, ["defect_id", "run"]).join(counts, ["defect_id", "run"], "left").drop("run")
    error = F.when(F.col("allowed"), F.col("_error")).otherwise(F.col("error"))
    return named.join(of_run, ["defect_id", "text_id"], "left").select(
        "defect_id", "extraction_request", "extraction_rows", error.alias("extraction_error"), (error == "").alias("extraction_useful"))


def extraction_probes(bench: Workbench) -> DataFrame:
    """Requests of every kind a response may carry: (defect_id, seed, variant, extraction_request)."""
    asked = parsed(bench).filter("kind = 'gold'").select("defect_id", "seed", "extraction_request")
    asked = asked.join(F.broadcast(bench.defects.select("defect_id", "class_index", "final_table")), "defect_id")
    request, final = F.col("extraction_request"), F.col("final_table")
    texts = {
        "plain": request,
        "respelled": F.concat(F.lit("/* the row */ "), F.replace(F.replace(request, F.lit("SELECT"), F.lit("select")), F.lit(" WHERE "), F.lit("\n where\t")), F.lit(" ; -- done")),
        "whole": F.concat(F.lit("SELECT * FROM "), final),
        "unknown column": F.concat(F.lit("SELECT no_such_column FROM "), final),
        "write": F.concat(F.lit("DROP TABLE "), final),
        # Runs into its fault only when it is executed.
        "fault": F.when(F.col("class_index") == 0, F.concat(F.lit("SELECT raise_error('broken') FROM "), final)),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("extraction_request")) for n, t in texts.items()])
    return asked.select("defect_id", "seed", F.explode(cells).alias("cell")).select("defect_id", "seed", "cell.*").dropna(subset=["extraction_request"])


def extractions(bench: Workbench) -> DataFrame:
    """The extraction requests of all responses, each executed once; written once."""
    return bench.store.table("extractions", lambda: extraction_runs(bench, parsed(bench)))


def graded(bench: Workbench) -> DataFrame:
    """Every response with its verdict, localisation, walk score, success and reward."""

    def build() -> DataFrame:
        read = parsed(bench)
        checks = verdicts(bench, read, "responses").drop("error")
        useful = extractions(bench).select("defect_id", "extraction_request", "extraction_useful")
        truth = bench.defects.select(
            "defect_id", "pipeline_id", "kind", "final_table", "defect_columns"
        ).withColumnRenamed("kind", "defect_kind")
        variant = F.create_map(*[F.lit(x) for pair in WALK_OF.items() for x in pair])
        walks = bench.walk_scores().select("defect_id", "seed", "variant", F.col("score").alias("walkthrough"))
        joined = (
            read.drop("error", "uses_truth")
            .join(F.broadcast(truth), "defect_id")
            .join(checks, ["defect_id", "candidate", "seed"], "left")
            .join(useful, ["defect_id", "extraction_request"], "left")
            .withColumn("variant", F.element_at(variant, F.col("kind")))
            .join(walks, ["defect_id", "seed", "variant"], "left")
            .na.fill(False, ["valid", "catch", "fp", "precise", "extraction_useful"])
            .na.fill(0.0, ["walkthrough"])
        )
        located = grading.grade_localization(joined).withColumn("success", grading.success())
        return scoring.reward(located).drop("candidate", "variant", "allowed")

    return bench.store.table("graded", build)
