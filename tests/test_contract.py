"""The contract of every defect: it bites on the trap, stays silent on the clean report."""

from __future__ import annotations

import math

import pytest

from __spark_entry__ import queries
from recon.plans.defects import DEFECTS
from recon.plans.reports import PIPELINES
from recon.plans.workbench import Workbench
from recon.operators.reconcile import diff_wide
from recon.sources.tables import SourceTables

# Flagged keys by full diff and, where different, by the gold diagnostic, at the smallest scale.
EXPECTED = {
    "CH01": 150, "CH02": 15, "NW01": 1472, "NW02": 1467, "SK01": 130, "SK02": 1474, "SK03": 27,
    "CM01": 150, "CM02": 150, "WO01": 10, "WO02": 10, "F101": (69, 68), "F102": 70, "TP01": 1251,
    "TP02": (1404, 495), "TD01": (200, 188), "TD02": (196, 10), "OF01": (9, 1), "OF02": 10,
    "IM01": 514, "IM02": 268, "ZT01": 10, "ZT02": 10, "ZS01": 5, "ZS02": 5,
}
CLEAN = {
    "customer_revenue": 150, "order_value": 1473, "order_performance": 1500, "sales_by_customer": 150,
    "nation_profile": 25, "supplier_season": 70, "part_margin": 1292, "item_sales": 195,
    "supplier_stats": 10, "order_stats": 1007, "supplier_sales": 10, "region_stats": 5,
}


@pytest.fixture(scope="module")
def bench(spark, folder):
    bench = Workbench(spark, folder)
    bench.write_reports()
    return bench


def test_clean_reports(bench):
    assert {p: bench.clean(p).count() for p in PIPELINES} == CLEAN


def test_flagged_keys(bench):
    full = {r.defect_id: r["count"] for r in bench.flagged().groupBy("defect_id").count().collect()}
    gold = {r.defect_id: r["count"] for r in bench.gold_flagged().groupBy("defect_id").count().collect()}
    for defect, expected in EXPECTED.items():
        pair = expected if isinstance(expected, tuple) else (expected, expected)
        assert (full[defect], gold[defect]) == pair, defect


@pytest.mark.parametrize("pipeline_id", sorted(PIPELINES))
def test_clean_is_silent(bench, pipeline_id):
    pipeline, clean = PIPELINES[pipeline_id], bench.clean(pipeline_id)
    staging = pipeline.staging(bench.sources)
    assert diff_wide(clean, clean, pipeline.keys).isEmpty()
    for defect in (d for d in DEFECTS if d.pipeline_id == pipeline_id):
        assert defect.gold(pipeline, clean, staging).isEmpty(), defect.defect_id


def test_planted_keys_are_flagged_and_stable(bench):
    planted = bench.planted()
    assert planted.join(bench.gold_flagged(), ["defect_id", "flagged_pk"], "left_anti").isEmpty()
    sizes = {r["count"] for r in planted.groupBy("defect_id", "seed").count().collect()}
    assert max(sizes) == 3 and min(sizes) >= 1


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_same_result_at_any_partitioning(spark, folder, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        sources = SourceTables(spark, folder)
        for defect in (d for d in DEFECTS if d.defect_id in ("SK02", "TP02", "CM01")):
            pipeline = PIPELINES[defect.pipeline_id]
            found = defect.diff(pipeline, defect.trap(pipeline, sources), pipeline.report(sources))
            expected = EXPECTED[defect.defect_id]
            assert found.count() == (expected[0] if isinstance(expected, tuple) else expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_flagged_key_gets_a_split(spark, folder, bench):
    got = queries()["stratified_split_all"](spark, folder).toPandas()
    assert len(got) == bench.gold_flagged().count()
    for defect, own in got.groupby("defect_id"):
        assert sorted(own.number) == list(range(len(own))), defect
        assert (own.split == "test").sum() == max(1, math.ceil(len(own) * 0.2)), defect
