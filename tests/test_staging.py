"""Shared staging: the same rows as staging each report for itself, one scan of the order lines, no exchange on keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recon.operators.reconcile import diff, diff_many
from recon.plans.defects import DEFECTS
from recon.plans.reports import LINES, PIPELINES
from recon.plans.staging import Grouping, Input, StepGraph, beside, is_clustered
from recon.plans.spec import Projection, StagedFrames, Step
from recon.plans.workbench import Workbench
from recon.sources.store import TableStore


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bench(spark, folder):
    bench = Workbench(spark, folder)
    bench.write_reports()
    return bench


@pytest.mark.parametrize("pipeline_id", sorted(PIPELINES))
def test_shared_staging_changes_no_row(bench, pipeline_id):
    p = PIPELINES[pipeline_id]
    alone = p.report(bench.sources)
    assert alone.dtypes == bench.clean(pipeline_id).dtypes
    assert alone.exceptAll(bench.clean(pipeline_id)).isEmpty() and bench.clean(pipeline_id).exceptAll(alone).isEmpty()


@pytest.mark.parametrize("defect_id", ("NW01", "SK03", "CM02", "F102", "TD01", "OF02", "IM02", "ZT01"))
def test_shared_staging_changes_no_trap(bench, defect_id):
    d = next(d for d in DEFECTS if d.defect_id == defect_id)
    alone = d.trap(PIPELINES[d.pipeline_id], bench.sources)
    assert alone.exceptAll(bench.trap(defect_id)).isEmpty() and bench.trap(defect_id).exceptAll(alone).isEmpty()


def test_order_lines_are_scanned_once(bench):
    """Of all 37 reports only the shared copy of the lines reads the source."""
    frames = bench.staged()
    reports = [p.report(frames) for p in PIPELINES.values()] + [d.trap(PIPELINES[d.pipeline_id], frames) for d in DEFECTS]
    assert not [r for r in reports if any("lineitem.parquet" in path for path in r.inputFiles())]
    written = [n for n in bench.store.names() if any("lineitem.parquet" in p for p in bench.graph.reads(n))]
    assert written == ["wide_lineitem"]


@pytest.mark.parametrize("pipeline_id", ("order_performance", "order_stats", "order_value", "part_margin"))
def test_no_exchange_on_bucketed_keys(spark, bench, pipeline_id):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in plan_of(PIPELINES[pipeline_id].report(bench.staged()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def rows_of(spark):
    return spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "a", 1), (2, "a", None), (None, "b", 3)], "k int, tag string, v int")


def test_merged_groupings_by_hand(spark):
    f = StagedFrames({"t": rows_of(spark)})
    t = Input("t", lambda f: f["t"])
    all_rows = Grouping(t, ("k",), {"n": ("count", F.lit(1)), "total": ("sum", F.col("v"))})
    tagged = Grouping(t, ("k",), {"n_a": ("count", F.lit(1)), "most": ("max", F.col("v"))}, ("a", F.col("tag") == "a"))
    got = {tuple(r) for r in beside(f, all_rows, tagged).collect()}
    assert got == {(1, 2, 12, 1, 5), (2, 2, 1, 2, 1), (None, 1, 3, None, None)}
    got = {tuple(r) for r in beside(f, tagged, all_rows).collect()}
    assert got == {(1, 1, 5, 2, 12), (2, 2, 1, 2, 1)}
    assert {tuple(r) for r in beside(f, tagged).collect()} == {(1, 1, 5), (2, 2, 1)}
    assert {r.k for r in beside(f, Grouping(t, ("k",))).collect()} == {1, 2, None}


def test_graph_by_hand(spark):
    store = TableStore(spark)
    store.buckets = 4
    graph = StepGraph(store, StagedFrames({"t": rows_of(spark)}), [])
    t = Input("t", lambda f: f["t"])

    def report(f):
        return beside(f, Grouping(t, ("k",), {"total": ("sum", F.col("v"))}), Grouping(t, ("tag",), {"n": ("count", F.lit(1))}))

    def other(f):
        return beside(f, Grouping(t, ("k",), {"n_a": ("count", F.lit(1))}, ("a", F.col("tag") == "a")))

    graph.write([report, other])
    assert [n for n in store.names() if n.startswith("by_k_")] == list(store.names())
    assert {tuple(r) for r in other(graph.frames()).collect()} == {(1, 1), (2, 2)}
    step = beside(graph.frames(), Grouping(t, ("k",), {"total": ("sum", F.col("v"))}))
    assert {tuple(r) for r in step.collect()} == {(1, 12), (2, 1), (None, 3)}


def test_one_name_is_one_column(spark, bench):
    with pytest.raises(ValueError):
        steps = [Step("a", "L0", "", Projection("t", lambda: {"x": F.col("v")})),
                 Step("b", "L0", "", Projection("t", lambda: {"x": F.col("k")}))]
        StepGraph(TableStore(spark), StagedFrames({"t": rows_of(spark)}), steps).write([])


def test_diff_of_many_is_the_diff_of_each(bench):
    pairs = {}
    for d in DEFECTS[:9]:
        p = PIPELINES[d.pipeline_id]
        pairs[d.defect_id] = (bench.trap(d.defect_id), bench.clean(p.pipeline_id), p.keys, d.primary)
    got = {tuple(r) for r in diff_many(pairs, "pair", "decimal(38,4)").collect()}
    want = set()
    for name, (trap, clean, keys, column) in pairs.items():
        rows = diff(trap, clean, keys, column).select(
            "flagged_pk", "side", F.col("reported").cast("decimal(38,4)"), F.col("expected").cast("decimal(38,4)")).collect()
        want |= {(name, *r) for r in rows}
    assert got == want and LINES.name.startswith("stg_lines")


def test_distinct_counts_under_conditions(spark):
    """Several distinct counts of one operand: same values and types as counted each for itself, no row repeated."""
    rows = spark.createDataFrame(
        [(1, "a", 5, 10), (1, "a", 5, 20), (1, "b", 7, 30), (1, "b", None, 40), (2, "a", None, 1), (3, "b", 5, 2), (None, "c", 9, 3)],
        "k int, tag string, v int, w int")
    store = TableStore(spark)
    store.buckets = 4
    source = Projection("t", lambda: {c: F.col(c) for c in rows.columns}, cluster=("v",))
    graph = StepGraph(store, StagedFrames({"t": rows}), [Step("stg", "L0", "", source)])
    graph.write([])
    f, t = StagedFrames({"t": rows}, graph), Input("t", lambda f: f["t"])
    measures = {"d": ("distinct", F.col("v")), "n": ("count", F.col("v")), "s": ("sum", F.col("w")), "m": ("max", F.col("w"))}
    plain = Grouping(t, ("k",), measures)
    a, b = (Grouping(t, ("k",), {f"{n}_{tag}": m for n, m in measures.items()}, (tag, F.col("tag") == tag)) for tag in "ab")
    merged = beside(f, plain, a, b)
    assert "Expand" not in plan_of(merged)
    assert {tuple(r) for r in merged.collect()} == {
        (1, 2, 3, 100, 40, 1, 2, 30, 20, 1, 1, 70, 40), (2, 0, 0, 1, 1, 0, 0, 1, 1, None, None, None, None),
        (3, 1, 1, 2, 2, None, None, None, None, 1, 1, 2, 2), (None, 1, 1, 3, 3, None, None, None, None, None, None, None, None)}
    assert dict(merged.dtypes) == dict(beside(f, plain).dtypes) | {f"{n}_{tag}": k for tag in "ab" for n, k in beside(f, plain).dtypes[1:]}
    # Rows that no condition wants are left out; groups without any are not served.
    assert {r.k for r in beside(f, a, b).collect()} == {1, 2}


def test_lines_are_bucketed_only_where_orders_are_even(spark):
    def staged(rows):
        store = TableStore(spark)
        store.buckets = 8
        step = Step("stg", "L0", "", Projection("t", lambda: {"k": F.col("k"), "v": F.col("v")}, cluster=("k",)))
        graph = StepGraph(store, StagedFrames({"t": rows}), [step])
        graph.write([])
        frames = graph.frames()
        assert graph.projected(step).exceptAll(rows).isEmpty() and graph.projected(step).count() == rows.count()
        return is_clustered(frames, step), plan_of(graph.projected(step).groupBy("k").agg(F.sum("v")))

    even = spark.range(200_000).select((F.col("id") / 4).cast("long").alias("k"), F.col("id").alias("v"))
    clustered, plan = staged(even)
    assert clustered and "Exchange" not in plan
    hot = even.withColumn("k", F.when(F.col("v") % 2 == 0, F.lit(7)).otherwise(F.col("k")))
    clustered, plan = staged(hot)
    assert not clustered and "Exchange" in plan


def test_pairs_bucketed_by_key_are_compared_in_place(bench):
    pairs = {}
    for d in DEFECTS:
        p = PIPELINES[d.pipeline_id]
        if p.keys == ("o_orderkey",):
            pairs[d.defect_id] = (bench.trap(d.defect_id), bench.clean(p.pipeline_id), p.keys, d.primary)
    # What is left is the one exchange of rows without a whole key.
    assert len(pairs) == 7 and plan_of(diff_many(pairs, "pair", "decimal(38,4)")).count("Exchange") == 1


def test_diff_of_many_by_hand(spark):
    """Null keys, null values, repeated and one-sided keys, as the diff of one pair flags them."""
    kind = "a int, b string, v int"
    mine = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "x", 3), (None, None, 4), (2, None, 5), (3, "z", None), (4, "q", 1), (4, "q", 9), (6, "s", None), (6, "s", 1)], kind)
    theirs = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (None, "x", 3), (None, None, 5), (5, None, 5), (3, "z", 1), (4, "q", 9), (6, "s", 1), (6, "s", 1)], kind)
    for keys in (["a", "b"], ["a"], ["b"]):
        got = diff_many({"p": (mine, theirs, keys, "v")}, "pair", "decimal(38,4)").drop("pair")
        want = diff(mine, theirs, keys, "v").select(
            "flagged_pk", "side", F.col("reported").cast("decimal(38,4)"), F.col("expected").cast("decimal(38,4)"))
        assert not want.isEmpty() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
