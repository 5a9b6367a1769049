"""Panel texts against sorting in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recon.operators.panel import panel_runs, panel_text


def fields():
    return [("seq", F.col("seq")), ("v", F.col("v"))]


@pytest.mark.parametrize("run_chars", (1, 40, 1 << 16))
def test_panel_by_hand(spark, run_chars):
    pick = random.Random(2)
    rows = [(pick.choice([1, 2, 3, None]), pick.choice([None, *range(20)]), pick.choice(["a", "b", None])) for _ in range(400)]
    rows += [(9, i, "hot") for i in range(3000)] + [(8, 1, "same")] * 50
    frame = spark.createDataFrame(rows, "k int, seq int, v string").withColumn("part", F.lit("clash"))
    want = {}
    for k, seq, v in rows:
        line = f"seq={seq} | v={v}"
        want.setdefault(k, []).append(((seq is not None, seq or 0), line))
    got = {r.k: (r.n_rows, r.panel) for r in panel_text(frame, "k", ["seq"], fields(), run_chars=run_chars).collect()}
    assert got == {k: (len(v), "\n  ".join(line for _, line in sorted(v))) for k, v in want.items()}


def test_a_hot_key_of_a_million_rows_spans_tasks(spark):
    frame = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.lit("x").alias("v"))
    runs = panel_runs(frame, "k", ["seq"], fields())
    sizes = runs.select("run", "n_rows", F.length("text").alias("n")).collect()
    assert sum(r.n_rows for r in sizes) == 1_000_000 and max(r.n for r in sizes) < 70_000 and len(sizes) > 200
    assert len({r.run >> 40 for r in sizes}) > 4
    row = panel_text(frame, "k", ["seq"], fields()).collect()[0]
    assert row.n_rows == 1_000_000 and row.panel == "\n  ".join(f"seq={i} | v=x" for i in range(1_000_000))


def test_panel_of_nothing(spark):
    frame = spark.createDataFrame([], "k int, seq int, v string")
    assert panel_text(frame, "k", ["seq"], fields()).count() == 0
