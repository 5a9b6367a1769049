"""Splits by selection against sorting each class."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from recon.operators import sampling, walk
from recon.sources.store import TableStore


def split_by_hand(rows, share):
    by_class = {}
    for group, seed, key in rows:
        digest = hashlib.md5(":".join(str(x) for x in (seed, key) if x is not None).encode()).hexdigest()
        by_class.setdefault(group, []).append((digest, key is not None, key))
    out = []
    for group, own in by_class.items():
        own.sort()
        cut = own[max(1, math.ceil(len(own) * share)) - 1]
        out += [(group, k, "test" if (d, p, k) <= cut else "train") for d, p, k in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("small,digits", ((4096, 3), (1, 1), (1, 2)))
def test_split_by_selection(spark, monkeypatch, small, digits):
    monkeypatch.setattr(sampling, "SMALL_RANGE", small)
    monkeypatch.setattr(sampling, "RANGE_DIGITS", digits)
    pick = random.Random(4)
    rows = [("big", 7, f"k{i}") for i in range(3000)] + [("one", 8, "only")] + [("hot", 9, "same")] * 900
    rows += [("hot", 9, f"h{i}") for i in range(40)] + [("nulls", 1, None), ("nulls", 1, "x")] + [(None, 2, "a"), (None, 2, "b")][:0]
    rows += [(f"c{pick.randint(0, 30)}", 3, str(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "class string, seed long, key string").withColumn("extra", F.lit(1))
    got = sampling.split_by_order(frame, "class", "seed", "key", 0.2)
    assert got.columns == ["class", "seed", "key", "extra", "split"]
    assert sorted(((r["class"], r.key, r.split) for r in got.collect()), key=str) == split_by_hand(rows, 0.2)


def test_split_of_nothing(spark):
    frame = spark.createDataFrame([], "class string, seed long, key string")
    assert sampling.split_by_order(frame, "class", "seed", "key").count() == 0


def test_sample_is_the_first_keys_in_stable_order(spark):
    """Against sorting every (group, seed): hot groups, repeated and null keys, few keys, no seeds, no keys."""
    pick = random.Random(9)
    rows = [("hot", f"h{pick.randint(0, 4000)}") for _ in range(30_000)] + [("same", "x")] * 5_000
    rows += [("nulls", None), ("nulls", None), ("nulls", "a"), ("few", "ü"), ("unasked", "z")]
    grid = [(g, s) for g in ("hot", "same", "nulls", "few", "no keys") for s in (1, 22, 333)] + [("hot", 1)]
    frame = spark.createDataFrame(rows, "class string, flagged_pk string").withColumn("seed", F.lit("clash")).repartition(16)
    seeds = spark.createDataFrame(grid, "class string, seed long")
    want = []
    for group, seed in set(grid):
        own = sorted((hashlib.md5(":".join(str(x) for x in (seed, k) if x is not None).encode()).hexdigest(), k is not None, k or "")
                     for g, k in rows if g == group)
        want += [(group, seed, i, k if known else None) for i, (_, known, k) in enumerate(own[:3], start=1)]
    plan = sampling.sample_keys(frame, seeds, "class")
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sampling.sample_keys(frame.limit(0), seeds, "class").count() == 0
    assert sampling.sample_keys(frame, seeds.limit(0), "class").count() == 0


@pytest.mark.parametrize("share", (1, 3, 1_024))
def test_sample_within_bounds(spark, monkeypatch, share):
    """Bounds from all, some or hardly any keys give the same sample, and no row leaves the JVM."""
    monkeypatch.setattr(sampling, "BOUND_ROWS", share, raising=False)
    rows = [(g, f"{g}{i}") for g, n in (("big", 9_000), ("small", 2), ("three", 3)) for i in range(n)] + [("same", "x")] * 50
    frame = spark.createDataFrame(rows, "class string, flagged_pk string").repartition(5)
    seeds = spark.createDataFrame([(g, s) for g in ("big", "small", "three", "same") for s in (5, 6)], "class string, seed long")
    want = []
    for group in ("big", "small", "three", "same"):
        for seed in (5, 6):
            own = sorted((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k) for g, k in rows if g == group)[:3]
            want += [(group, seed, i, k) for i, (_, k) in enumerate(own, start=1)]
    plan = sampling.sample_keys(frame, seeds, "class")
    assert sorted(map(tuple, plan.collect())) == sorted(want)
    assert "InArrow" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sample_row_is_the_smallest_and_found_by_its_first_column(spark):
    rows = [(2, "b", 0.5), (1, "z", None), (1, "a", 2.0), (1, "a", None)]
    kind = "`k.1` int, t string, v double"
    assert walk.first_row_text(spark.createDataFrame(rows, kind)).first().evidence == "k.1=1 | t=a | v=None"
    unkeyed = spark.createDataFrame([*rows, (None, "q", 1.0), (None, None, 3.0)], kind)
    assert walk.first_row_text(unkeyed).first().evidence == "k.1=None | t=None | v=3.0"
    assert walk.first_row_text(spark.createDataFrame([], kind)).first().evidence is None
    plan = walk.first_row_text(unkeyed)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan  # only rows with the smallest first column are compared whole


def test_rows_of_a_file_are_bounded_where_asked(spark):
    store = TableStore(spark)
    rows = spark.range(0, 1000, 1, 1).withColumn("same", F.lit("x"))
    table = store.table("even", lambda: rows, file_rows=100)
    held = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert held == [100] * 10 and table.distinct().count() == 1000
    whole = store.table("whole", lambda: rows)
    assert [r["count"] for r in whole.groupBy(F.input_file_name()).count().collect()] == [1000]
