"""Staging that reports share: equal steps are merged, and each is written once.

A report asks for its children as groupings: measures per key over an input, perhaps over some of its rows
only. Groupings over one input and key are one step whoever asks; its measures are the union of all that are
asked for, and a condition becomes part of the measure, so one pass serves every report and every defect. In the
same way all projections of a source become one table with the union of their columns.

``StepGraph`` is that graph for many reports. It learns what they ask for by building each once on stand-ins for
its tables, then writes the projections, and the groupings that more than one report or step asks for, bucketed by
their key: a grouping has one row per key, so no bucket can be hot, and joins on that key need no exchange. Order
lines are bucketed by their order where their keys are spread evenly, which is counted first (``_is_even``), so that
groupings and joins by order need no exchange either; an order may hold any share of them, and then they are not. A report
that is built alone, without a graph, merges what it asks for in one go (``beside``) and computes it in place.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.plans.spec import Frames, StagedFrames, Step
from recon.sources.store import TableStore

#: Cells a bucket in which rows are counted by key, and how far the fullest may exceed the mean, or this many rows.
CELLS, UNEVEN, FEW_ROWS = 8, 4, 20_000

Measures = Mapping[str, tuple[str, Column]]
Condition = tuple[str, Column]

_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "count": F.count, "distinct": F.count_distinct, "max": F.max,
}


@dataclass(frozen=True)
class Input:
    """What is grouped; equal names mean equal rows."""

    name: str
    build: Callable[[Frames], DataFrame]


@dataclass(frozen=True, eq=False)
class Grouping:
    """Measures per key. ``where`` names a condition on the input's rows; equal names mean equal conditions."""

    input: Input
    keys: tuple[str, ...]
    measures: Measures = field(default_factory=dict)
    where: Condition | None = None

    @property
    def step(self) -> tuple[str, tuple[str, ...]]:
        return self.input.name, self.keys

    @property
    def label(self) -> str | None:
        return self.where[0] if self.where else None

    def columns(self) -> dict[str, str]:
        """Name of each measure in this grouping to its name in the merged step."""
        return {name: _digest(kind, str(operand), self.label) for name, (kind, operand) in self.measures.items()}


def _digest(*parts: str | None) -> str:
    return "m_" + hashlib.md5("\x1f".join(p or "" for p in parts).encode()).hexdigest()[:16]


def _present(label: str) -> str:
    return _digest("present", label)


def step_input(step: Step) -> Input:
    """A staging step as an input; steps of one name that differ are told apart by what they describe."""
    return Input(f"{step.name}: {step.description}", lambda f: resolve(f, step))


def resolve(f: Frames, step: Step) -> DataFrame:
    """A staging step, from the graph where there is one."""
    graph = getattr(f, "graph", None)
    return graph.projected(step) if graph and step.projection else step.build(f)


def is_clustered(f: Frames, step: Step) -> bool:
    """Whether the shared copy of a projection lies bucketed by a key that may repeat; then no key of it is hot."""
    graph = getattr(f, "graph", None)
    return bool(graph and graph.closed and graph.clustered(step.projection.source))


def _is_even(rows: DataFrame, keys: tuple[str, ...], buckets: int) -> bool:
    """Whether no bucket of these keys would hold far more rows than others; one pass over the keys."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(buckets * CELLS))
    seen = rows.groupBy(cell.alias("_cell")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    return (seen["most"] or 0) <= max(FEW_ROWS, UNEVEN * (seen["n"] or 0) / (buckets * CELLS))


class _StandIn:
    """A table of which nothing is known: every operation on it gives it again."""

    def __getattr__(self, name: str) -> Callable[..., _StandIn]:
        return lambda *_, **__: self

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _merged(f: Frames, requests: list[Grouping]) -> DataFrame:
    """All requests over one input and key in one aggregation; rows that no condition wants are left out."""
    first = requests[0]
    rows, labels = first.input.build(f), {r.label for r in requests}
    wheres = {r.label: r.where[1] for r in requests if r.where}
    if None not in labels:
        rows = rows.where(reduce(lambda a, b: a | b, wheres.values()))
    aggregates = {}
    members = {}
    for r in requests:
        inside = r.where[1] if r.where and len(labels) > 1 else None
        for name, column in r.columns().items():
            kind, operand = r.measures[name]
            if kind == "distinct":
                members.setdefault(str(operand), {})[column] = (operand, inside)
            aggregates[column] = _AGGREGATES[kind](operand if inside is None else F.when(inside, operand)).alias(column)
        if inside is not None:
            aggregates[_present(r.label)] = F.count_if(inside).alias(_present(r.label))
    graph = getattr(f, "graph", None)
    if len(members) == 1 and len(next(iter(members.values()))) > 1 and graph and graph.lies_by(next(iter(members.values()))):
        return _by_member(rows, first.keys, aggregates, next(iter(members.values())), requests)
    return rows.groupBy(*first.keys).agg(*aggregates.values()) if aggregates else rows.select(*first.keys).distinct()


def _by_member(
    rows: DataFrame, keys: tuple[str, ...], aggregates: dict[str, Column], members: dict[str, tuple[Column, Column | None]],
    requests: list[Grouping],
) -> DataFrame:
    """The same aggregation where distinct values of one operand are counted under several conditions.

    Catalyst would repeat every row for each of those counts. Here rows, which lie bucketed by the operand, are
    grouped by key and operand first, where each condition leaves a flag, and then by key.
    """
    kinds = {c: r.measures[n][0] for r in requests for n, c in r.columns().items()}
    types = {f.name: f.dataType for f in rows.groupBy(*keys).agg(*aggregates.values()).schema.fields}
    operand = next(iter(members.values()))[0]
    flags = {c: (F.lit(True) if inside is None else inside) & operand.isNotNull() for c, (_, inside) in members.items()}
    inner = rows.withColumn("_member", operand).groupBy(*keys, "_member").agg(
        *[F.max(F.coalesce(flags[c], F.lit(False))).alias(c) if c in members else a for c, a in aggregates.items()])
    again = {c: F.count_if(F.col(c)) if c in members else F.max(c) if kinds.get(c) == "max" else F.sum(c) for c in aggregates}
    return inner.groupBy(*keys).agg(*[a.cast(types[c]).alias(c) for c, a in again.items()])


def _served(step: DataFrame, first: Grouping, others: list[Grouping]) -> DataFrame:
    """The groups of ``first`` with its measures and those of others over the same step."""
    known = set(step.columns)
    present = _present(first.label) if first.where else ""
    out = []
    for r in (first, *others):
        seen = _present(r.label) if r.where else ""
        for name, column in r.columns().items():
            value = F.col(column)
            out.append((F.when(F.col(seen) > 0, value) if r is not first and seen in known else value).alias(name))
    return (step.where(F.col(present) > 0) if present in known else step).select(*first.keys, *out)


def beside(f: Frames, first: Grouping, *others: Grouping) -> DataFrame:
    """One row per group of ``first``, with the measures of the others beside its own (null: no such group).

    Others of the same step come from the same aggregation; the rest are joined by their keys.
    """
    graph = getattr(f, "graph", None)
    same = [o for o in others if o.step == first.step]
    if graph and not graph.closed:
        graph.ask([first, *same], [o for o in others if o.step != first.step])
        return _StandIn()
    step = graph.step([first, *same]) if graph else _merged(f, [first, *same])
    out = _served(step, first, same)
    for o in others:
        if o.step != first.step:
            theirs = beside(f, o)
            for mine, key in zip(first.keys, o.keys):
                theirs = theirs.withColumnRenamed(key, f"_{mine}")
            on = [out[k] == theirs[f"_{k}"] for k in first.keys]
            out = out.join(theirs, on, "left").drop(*[f"_{k}" for k in first.keys])
    return out


class StepGraph:
    """The merged steps of many reports over one folder of sources."""

    def __init__(self, store: TableStore, sources: Frames, steps: list[Step]):
        self.store = store
        self.sources = sources
        self.closed = False
        self._steps = {s: None for s in steps if s.projection}
        self._asked: dict[tuple[str, tuple[str, ...]], dict[tuple, Grouping]] = {}
        self._askers: dict[tuple[str, tuple[str, ...]], int] = {}
        self._projected: dict[Step, DataFrame] = {}
        self._sources: dict[str, list[str]] = {}
        self._clustered: dict[str, tuple[str, ...]] = {}
        self._lock = threading.Lock()

    def frames(self) -> StagedFrames:
        if self.closed:
            return StagedFrames(self.sources, self)
        return StagedFrames({name: _StandIn() for name in self.sources}, self)

    def ask(self, together: list[Grouping], apart: list[Grouping]) -> None:
        """Note what one report or step asks for; those over one step count as one asking."""
        for requests in (together, *[[r] for r in apart]):
            new = requests[0].step not in self._asked
            known = self._asked.setdefault(requests[0].step, {})
            self._askers[requests[0].step] = self._askers.get(requests[0].step, 0) + 1
            for r in requests:
                known[r.label, tuple(sorted(r.columns().values()))] = r
            if new:
                requests[0].input.build(self.frames())

    def write(self, reports: list[Callable[[Frames], object]]) -> None:
        """Learn what the reports ask for, then write what they share; later ``frames`` read what is written."""
        with self._lock:
            if self.closed:
                return
            for report in reports:
                report(self.frames())
            self.closed = True
        with self.store.workers() as pool:
            list(pool.map(self._wide, {s.projection.source for s in self._steps}))
            list(pool.map(self._grouped, [step for step, n in self._askers.items() if n > 1]))

    def projected(self, step: Step) -> DataFrame:
        if not self.closed:
            return _StandIn()
        if step not in self._projected:
            p = step.projection
            wide = self._wide(p.source)
            self._projected[step] = (wide.where(p.where()) if p.where else wide).select(*p.columns())
        return self._projected[step]

    def reads(self, name: str) -> list[str]:
        """The files a written step was computed from."""
        return self._sources.get(name, [])

    def clustered(self, source: str) -> tuple[str, ...]:
        """The repeating key by which the copy of a source is bucketed, empty if by none."""
        return self._clustered.get(source, ())

    def lies_by(self, members: dict[str, tuple[Column, Column | None]]) -> bool:
        """Whether a written projection lies bucketed by the one operand of these counts."""
        operand = str(next(iter(members.values()))[0])
        keys = [s.projection.key or self.clustered(s.projection.source) for s in self._steps]
        return bool(self.closed and self.store.buckets) and any(operand == str(F.col(k[0])) for k in keys if len(k) == 1)

    def _wide(self, source: str) -> DataFrame:
        """All projections of a source as one table: the union of their columns, and of what they filter by."""
        projections = [s.projection for s in self._steps if s.projection.source == source]
        columns: dict[str, Column] = {}
        for p in projections:
            for name, column in ({c: F.col(c) for c in p.carry} | p.columns()).items():
                if str(columns.setdefault(name, column)) != str(column):
                    raise ValueError(f"two columns named {name} are staged from {source}")
        wheres = {str(p.where()) if p.where else None for p in projections}

        def build() -> DataFrame:
            rows = self.sources[source]
            if len(wheres) == 1 and projections[0].where:
                rows = rows.where(projections[0].where())
            wide = rows.select(*[c.alias(n) for n, c in columns.items()])
            self._sources[f"wide_{source}"] = wide.inputFiles()
            return wide

        keys = {p.key or p.cluster for p in projections}
        key = keys.pop() if len(keys) == 1 else ()
        if key and not all(p.key for p in projections):
            if source not in self._clustered:
                even = self.store.buckets and _is_even(self.sources[source], key, self.store.buckets)
                self._clustered[source] = key if even else ()
            key = self._clustered[source]
        return self.store.table(f"wide_{source}", build, keys=key)

    def _grouped(self, step: tuple[str, tuple[str, ...]]) -> DataFrame:
        requests = list(self._asked[step].values())
        name = f"by_{'_'.join(step[1])}_{_digest(step[0])}"

        def build() -> DataFrame:
            grouped = _merged(self.frames(), requests)
            self._sources[name] = grouped.inputFiles()
            return grouped

        return self.store.table(name, build, keys=step[1])

    def step(self, requests: list[Grouping]) -> DataFrame:
        """The merged step of requests over one input and key: written where it is shared."""
        key = requests[0].step
        if self._askers.get(key, 0) > 1:
            return self._grouped(key)
        return _merged(self.frames(), requests)
