"""Everything derived from one source folder, each table written once and shared.

A trap depends on its defect only; seeds merely pick other keys from it. So each report and trap
is built once, and seeds are a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recon.operators import sampling, walk
from recon.operators.reconcile import diff_many, keys_once
from recon.plans.defects import DEFECTS, DEFECTS_BY_ID
from recon.plans.reports import PIPELINES
from recon.plans.spec import Defect, Frames, Pipeline, StagedFrames
from recon.plans.staging import StepGraph
from recon.sources.store import FILE_ROWS, store_for
from recon.sources.tables import SourceTables

EPISODES_PER_DEFECT = 6

DEFECT_TYPE = (
    "class_index int, defect_id string, pipeline_id string, domain string, final_table string, "
    "pk string, kind string, dimension string, category string, severity string, "
    "description string, defect_columns array<string>, gold_sql string, broad_sql string"
)
LAYER_TYPE = (
    "defect_id string, final_table string, n_steps int, expected_layers array<string>"
)


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def defect_table(spark: SparkSession) -> DataFrame:
    """The defects as a dimension table; ``defect_columns`` starts with the primary one."""
    rows = []
    for index, d in enumerate(DEFECTS):
        p = PIPELINES[d.pipeline_id]
        rows.append(
            (index, d.defect_id, d.pipeline_id, p.domain, p.final_table, p.pk, d.kind, d.dimension,
             d.category, d.severity, d.description, list(d.columns), d.gold_sql(p), d.broad_sql(p))
        )
    return spark.createDataFrame(rows, DEFECT_TYPE)


def layer_table(spark: SparkSession) -> DataFrame:
    """Per defect the layers of its pipeline from the reported table to the sources."""
    rows = []
    for d in DEFECTS:
        p = PIPELINES[d.pipeline_id]
        rows.append((d.defect_id, p.final_table, len(p.steps), [s.layer for s in reversed(p.steps)]))
    return spark.createDataFrame(rows, LAYER_TYPE)


class Workbench:
    """Shared derived tables of one source folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.sources = SourceTables(spark, folder)
        self.store = store_for(spark, self.sources.folder)
        self.defects = defect_table(spark)
        self.graph = self.store.once("graph", lambda: StepGraph(
            self.store, self.sources, [s for p in PIPELINES.values() for s in p.steps]))

    def staged(self) -> StagedFrames:
        """The sources with all staging that reports share, written once."""
        reports: list[Callable[[Frames], object]] = [p.report for p in PIPELINES.values()]
        reports += [lambda f, d=d: d.trap(PIPELINES[d.pipeline_id], f) for d in DEFECTS]
        self.store.size_buckets(self.sources["lineitem"])
        self.graph.write(reports)
        return self.graph.frames()

    def clean(self, pipeline_id: str) -> DataFrame:
        """A report, written once and bucketed by its keys, which repeat in no healthy one."""
        pipeline = PIPELINES[pipeline_id]
        return self.store.table(f"clean_{pipeline_id}", lambda: pipeline.report(self.staged()), keys=pipeline.keys)

    def trap(self, defect_id: str) -> DataFrame:
        defect = DEFECTS_BY_ID[defect_id]
        pipeline = PIPELINES[defect.pipeline_id]
        return self.store.table(f"trap_{defect_id}", lambda: defect.trap(pipeline, self.staged()), keys=pipeline.keys)

    def write_reports(self, with_clean: bool = True) -> None:
        """Write all traps and, unless told otherwise, all reports, several jobs at a time.

        All are bucketed alike, so comparing a trap with its report or its staging by key moves no row.
        """
        self.staged()
        builds: list[Callable[[], DataFrame]] = [lambda p=p: self.clean(p) for p in PIPELINES if with_clean]
        builds += [lambda d=d: self.trap(d.defect_id) for d in DEFECTS]
        with self.store.workers() as pool:
            list(pool.map(lambda build: build(), builds))

    def per_defect(self, build: Callable[[Defect, Pipeline], DataFrame], with_clean: bool = True) -> DataFrame:
        self.write_reports(with_clean)
        return stacked(
            [
                build(d, PIPELINES[d.pipeline_id]).withColumn("defect_id", F.lit(d.defect_id))
                for d in DEFECTS
            ]
        )

    def parts_by_defect(
        self, name: str, build: Callable[[Defect, Pipeline], DataFrame], with_clean: bool = True, file_rows: int = 0
    ) -> DataFrame:
        """The same as table ``name``, a job for each defect."""
        self.write_reports(with_clean)
        return self.store.parts(name, {
            d.defect_id: lambda d=d: build(d, PIPELINES[d.pipeline_id]).withColumn("defect_id", F.lit(d.defect_id)) for d in DEFECTS
        }, file_rows)

    def keyed_once(self) -> set[str]:
        """Names of the written reports and traps in which no key is null or repeats; one job over their keys."""

        def build() -> DataFrame:
            self.write_reports()
            tables = {f"clean_{p.pipeline_id}": (self.clean(p.pipeline_id), p.keys) for p in PIPELINES.values()}
            tables |= {f"trap_{d.defect_id}": (self.trap(d.defect_id), PIPELINES[d.pipeline_id].keys) for d in DEFECTS}
            return stacked([keys_once(frame, keys).select(F.lit(name).alias("name"), "once") for name, (frame, keys) in tables.items()])

        return {row["name"] for row in self.store.table("keyed_once", build).where("once").collect()}  # one row a report

    def flagged(self) -> DataFrame:
        """All keys the full diff flags, for every defect; not written, as the reports it compares are."""
        self.write_reports()
        return stacked([self._flagged_of(d) for d in DEFECTS])

    def _flagged_of(self, d: Defect) -> DataFrame:
        p = PIPELINES[d.pipeline_id]
        trap, clean = f"trap_{d.defect_id}", f"clean_{p.pipeline_id}"
        pair = {d.defect_id: (self.trap(d.defect_id), self.clean(p.pipeline_id), p.keys, d.primary)}
        return diff_many(pair, "defect_id", "decimal(38,4)", {d.defect_id: (self.store.files(trap), self.store.files(clean))})

    def flagged_counts(self) -> DataFrame:
        """How many keys the full diff flags, for every defect that it flags any of."""
        self.write_reports()
        return self.store.parts("flagged_counts", {
            d.defect_id: lambda d=d: self._flagged_of(d).groupBy("defect_id").agg(F.count("*").alias("n_flagged")) for d in DEFECTS})

    def gold_flagged(self) -> DataFrame:
        """All keys the gold diagnostic flags on the trap, for every defect."""

        def one(d: Defect, p: Pipeline) -> DataFrame:
            return d.gold(p, self.trap(d.defect_id), p.staging(self.staged()))

        # Every key is hashed once a seed by those who read it.
        return self.parts_by_defect("gold_flagged", one, with_clean=False, file_rows=FILE_ROWS)

    def seeds(self) -> DataFrame:
        classes = self.defects.select("defect_id", "class_index")
        return sampling.seed_grid(classes, EPISODES_PER_DEFECT)

    def planted(self) -> DataFrame:
        """Planted keys per (defect, seed), at most three each; rank 1 is the suspect."""
        return self.store.table(
            "planted", lambda: sampling.sample_keys(self.gold_flagged(), self.seeds(), "defect_id")
        )

    def suspects(self) -> DataFrame:
        return self.planted().filter("rank = 1").drop("rank")

    def suspect_rows(self) -> DataFrame:
        """The suspect row of every (defect, seed) as text."""

        def build() -> DataFrame:
            keys: dict[str, list[str | None]] = {}
            for row in self.suspects().collect():  # one row per (defect, seed) of the grid
                keys.setdefault(row.defect_id, []).append(row.flagged_pk)

            def one(d: Defect, p: Pipeline) -> DataFrame:
                mine = list(dict.fromkeys(keys.get(d.defect_id, [])))
                sides = [self.store.files(n) for n in (f"trap_{d.defect_id}", f"clean_{p.pipeline_id}")]
                return walk.suspect_sides(mine, *sides, p.pk)

            found = walk.suspect_rows(self.parts_by_defect("suspect_sides", one), ["defect_id", "flagged_pk"])
            return self.suspects().join(found, ["defect_id", "flagged_pk"])

        return self.store.table("suspect_rows", build)

    def layer_samples(self) -> DataFrame:
        """One sample row of every staging table: (pipeline_id, position, evidence)."""

        def of(p: Pipeline) -> DataFrame:
            staging = p.staging(self.staged())
            return stacked([
                walk.first_row_text(staging[step.name]).select(
                    F.lit(p.pipeline_id).alias("pipeline_id"), F.lit(position).alias("position"), "evidence")
                for position, step in enumerate(reversed(p.steps[:-1]), start=1)
            ])

        self.staged()
        return self.store.parts("layer_samples", {p.pipeline_id: lambda p=p: of(p) for p in PIPELINES.values()})

    def walks(self) -> DataFrame:
        """The gold layer walk of every (defect, seed), one row per step."""
        rows = []
        for d in DEFECTS:
            for position, s in enumerate(reversed(PIPELINES[d.pipeline_id].steps)):
                rows.append((d.defect_id, d.pipeline_id, position, s.layer, s.name, s.description))
        steps = self.spark.createDataFrame(
            rows,
            "defect_id string, pipeline_id string, position int, layer string, table_name string, "
            "transformation string",
        )
        suspects = self.suspect_rows().select(
            "defect_id", "seed", F.col("flagged_pk").alias("suspect_pk"), "row_text"
        )
        is_final = F.col("position") == 0
        return (
            suspects.join(F.broadcast(steps), "defect_id")
            .join(F.broadcast(self.layer_samples()), ["pipeline_id", "position"], "left")
            .withColumn("evidence", F.when(is_final, F.col("row_text")).otherwise(F.col("evidence")))
            .withColumn("evidence_pk", F.when(is_final, F.col("suspect_pk")))
            .select(
                "defect_id", "seed", "suspect_pk", "position", "layer", "table_name",
                "transformation", "evidence", "evidence_pk",
            )
        )

    def walk_variants(self) -> DataFrame:
        """The gold walk, one that stops a step short, and one told from source to report."""
        walks = self.walks()
        last = F.max("position").over(Window.partitionBy("defect_id", "seed"))
        with_last = walks.withColumn("_last", last)
        gold = with_last.withColumn("variant", F.lit("gold"))
        short = with_last.filter(F.col("position") < F.col("_last")).withColumn("variant", F.lit("short"))
        turned = with_last.withColumn("variant", F.lit("reversed")).withColumn(
            "position", F.col("_last") - F.col("position")
        )
        return stacked([gold, short, turned]).drop("_last")

    def walk_scores(self) -> DataFrame:
        return self.store.table(
            "walk_scores",
            lambda: walk.layer_walk_score(
                self.walk_variants(), F.broadcast(layer_table(self.spark)),
                ["defect_id", "seed", "variant"],
            ),
        )

