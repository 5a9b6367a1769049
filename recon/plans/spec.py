"""What a reporting pipeline and a defect are."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from recon.functions.text import key_text
from recon.operators.reconcile import diff, missing_rows, row_mismatch

Frames = Mapping[str, DataFrame]
Build = Callable[[Frames], DataFrame]


class StagedFrames(dict):
    """Frames by name, and the graph of shared steps they come from, if any."""

    def __init__(self, frames: Frames, graph=None):
        super().__init__(frames)
        self.graph = graph or getattr(frames, "graph", None)


@dataclass(frozen=True)
class Projection:
    """A staging step that only selects: columns of one source, under a condition on those or on ``carry``.

    ``key`` is unique in the source (empty where there is none); rows of a shared copy are bucketed by it.
    ``cluster`` may repeat: a shared copy is bucketed by it where none of its values holds many rows.
    """

    source: str
    columns: Callable[[], dict[str, Column]]
    where: Callable[[], Column] | None = None
    carry: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    cluster: tuple[str, ...] = ()

    def __call__(self, f: Frames) -> DataFrame:
        rows = f[self.source].where(self.where()) if self.where else f[self.source]
        return rows.select(*[c.alias(n) for n, c in self.columns().items()])


@dataclass(frozen=True)
class Step:
    """One named transformation with its layer label."""

    name: str
    layer: str
    description: str
    build: Build

    @property
    def projection(self) -> Projection | None:
        return self.build if isinstance(self.build, Projection) else None


@dataclass(frozen=True)
class Pipeline:
    """Ordered steps ending in the reported table, which is identified by ``keys``."""

    pipeline_id: str
    domain: str
    keys: tuple[str, ...]
    pk: str
    lineage: str
    steps: tuple[Step, ...]
    source_table: str = ""
    heavy: bool = False

    @property
    def final(self) -> Step:
        return self.steps[-1]

    @property
    def final_table(self) -> str:
        return self.final.name

    def staging(self, sources: Frames) -> dict[str, DataFrame]:
        """Sources plus every staging step, shared by the clean report and its traps."""
        frames = StagedFrames(sources)
        for step in self.steps[:-1]:
            shared = frames.graph and step.projection
            frames[step.name] = frames.graph.projected(step) if shared else step.build(frames)
        return frames

    def report(self, sources: Frames, final: Build | None = None) -> DataFrame:
        """The reported table; ``final`` replaces the last step."""
        return (final or self.final.build)(self.staging(sources))


@dataclass(frozen=True)
class Defect:
    """A mutated last step, what it is, and the columns it spoils (the first is primary)."""

    defect_id: str
    pipeline_id: str
    kind: str
    dimension: str
    category: str
    severity: str
    description: str
    columns: tuple[str, ...]
    build: Build
    check: tuple[str, ...]
    eps: float | None = None

    @property
    def primary(self) -> str:
        return self.columns[0]

    def trap(self, pipeline: Pipeline, sources: Frames) -> DataFrame:
        return pipeline.report(sources, self.build)

    def diff(self, pipeline: Pipeline, reported: DataFrame, expected: DataFrame) -> DataFrame:
        return diff(reported, expected, pipeline.keys, self.primary, self.eps)

    def gold(self, pipeline: Pipeline, reported: DataFrame, staging: Frames) -> DataFrame:
        """The short diagnostic: a row invariant on the report, or an anti-join to a source."""
        if self.check[0] == "missing":
            missing = missing_rows(staging[self.check[1]], reported, pipeline.keys)
            return missing.select("flagged_pk")
        calc, ref = self.check[1:]
        return row_mismatch(reported, pipeline.keys, calc, ref, self.eps)

    def gold_sql(self, pipeline: Pipeline) -> str:
        """The same diagnostic as query text over the working tables."""
        key = " || ':' || ".join(f"CAST(f.{k} AS STRING)" for k in pipeline.keys)
        if len(pipeline.keys) == 1:
            key = f"CAST(f.{pipeline.keys[0]} AS STRING)"
        if self.check[0] == "missing":
            on = " AND ".join(f"t.{k} = f.{k}" for k in pipeline.keys)
            return (
                f"SELECT {key} AS flagged_pk FROM {self.check[1]} f "
                f"LEFT JOIN {pipeline.final_table} t ON {on} WHERE t.{pipeline.keys[0]} IS NULL"
            )
        calc, ref = self.check[1:]
        return (
            f"SELECT {key} AS flagged_pk FROM {pipeline.final_table} f "
            f"WHERE f.{calc} IS DISTINCT FROM f.{ref}"
        )

    def broad_sql(self, pipeline: Pipeline) -> str:
        """A query that flags every reported key."""
        key = " || ':' || ".join(f"CAST({k} AS STRING)" for k in pipeline.keys)
        return f"SELECT {key} AS flagged_pk FROM {pipeline.final_table}"


def keyed(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Put the rendered composite key in front as ``row_key``."""
    return frame.select(key_text(keys).alias("row_key"), "*")
