"""Drift by digests against comparing rows; publishing behind a gate."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from recon.operators import drift
from recon.sources import catalog
from recon.sources.publish import GateError, publish

TYPE = "k int, g string, v double, w array<string>"


def by_hand(stored, current):
    def grouped(rows):
        out = {}
        for k, g, v, w in rows:
            out.setdefault((k, g), []).append(str((v, w)))
        return {key: sorted(values) for key, values in out.items()}

    a, b = grouped(stored), grouped(current)
    kind = lambda key: drift.DROPPED if key not in b else drift.ADDED if key not in a else drift.ALTERED
    return {(*key, kind(key)) for key in a.keys() | b.keys() if a.get(key) != b.get(key)}


@pytest.mark.parametrize("few,bits", ((100_000, 12), (3, 2), (0, 12)))
def test_drift_by_hand(spark, monkeypatch, few, bits):
    monkeypatch.setattr(drift, "FEW_ROWS", few)
    monkeypatch.setattr(drift, "LEVEL_BITS", bits)
    pick = random.Random(1)
    rows = [(pick.choice([None, *range(300)]), pick.choice(["a", None]), pick.choice([1.0, 2.5, None]), pick.choice([[], ["x"], None])) for _ in range(900)]
    current = [r for r in rows if pick.random() > 0.01] + [(1000, "new", 1.0, None), (rows[5][0], rows[5][1], 9.0, ["x"])]
    stored = rows + [rows[7]] + [(-5, None, None, None)]
    pick.shuffle(current)
    frames = [spark.createDataFrame(r, TYPE) for r in (stored, current)]
    got = {tuple(r) for r in drift.drifted(*frames, ["k", "g"], ["v", "w"]).collect()}
    assert got == by_hand(stored, current) and len(got) > 5


def test_equal_tables_do_not_drift(spark):
    frame = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    assert drift.drifted(frame, frame.repartition(7), ["k"], ["v"]).count() == 0
    assert drift.drifted(frame.limit(0), frame.limit(0), ["k"], ["v"]).count() == 0
    shifted = frame.withColumn("v", F.when(F.col("k") == 77, None).otherwise(F.col("v")))
    assert [tuple(r) for r in drift.drifted(frame, shifted, ["k"], ["v"]).collect()] == [(77, drift.ALTERED)]


def test_published_when_checks_hold(spark, tmp_path):
    frame, path = spark.range(100), str(tmp_path / "out" / "table")
    seen = publish(frame, path, {"some": F.count("*") > 5, "small": F.max("id") < 100}, measures={"total": F.sum("id")})
    assert seen["n_rows"] == 100 and seen["total"] == 4950
    assert spark.read.parquet(path).count() == 100 and os.listdir(tmp_path / "out") == ["table"]
    with pytest.raises(FileExistsError):
        publish(frame, path, {})


def test_nothing_is_published_when_a_check_fails(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(GateError) as caught:
        publish(spark.range(100), path, {"some": F.count("*") > 5, "few": F.count("*") < 50, "unknown": F.max(F.lit(None).cast("boolean"))}, "json")
    assert caught.value.failed == ["few", "unknown"] and caught.value.seen["n_rows"] == 100
    with pytest.raises(Exception, match="broken"):
        publish(spark.range(10).select(F.raise_error(F.lit("broken")).cast("string").alias("x")), path, {})
    assert os.listdir(tmp_path) == []


def test_unusable_sources_fail_the_job(spark):
    catalog.require_usable({"a": spark.range(1), "b": spark.range(0)})
    for tables in ({"a": spark.range(3)}, {"a": spark.range(0), "b": spark.range(0)}):
        with pytest.raises(ValueError, match="unusable"):
            catalog.require_usable(tables)


def test_planted_drift_samples_once(spark, folder):
    """The second sample is written; comparing it reads neither the flagged keys nor the buckets of the reports again."""
    from __spark_entry__ import queries
    from recon.plans.workbench import Workbench

    result = queries()["planted_drift"](spark, folder)
    assert not [p for p in result.inputFiles() if "gold_flagged" in p]
    bench = Workbench(spark, folder)
    looked_up = bench.store.files("trap_SK01")
    assert "SelectedBucketsCount" not in looked_up._jdf.queryExecution().executedPlan().toString()
    assert looked_up.exceptAll(bench.trap("SK01")).isEmpty() and bench.trap("SK01").exceptAll(looked_up).isEmpty()
