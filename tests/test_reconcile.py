"""Reconciliation on the cases that break naive diffs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recon.operators.fanout import fanout_profile
from recon.operators.joins import row_counts, salted_lookup
from recon.operators.reconcile import (
    diff, diff_wide, diff_wide_counts, keys_once, missing_rows, repeated_keys, row_mismatch, schema_diff,
)

TYPE = "k string, v double"


def flags(frame):
    return sorted((r.flagged_pk or "~", r.side) for r in frame.collect())


def test_missing_extra_changed_and_null_keys(spark):
    reported = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("x", 9.0)], TYPE)
    expected = spark.createDataFrame([("a", 1.0), ("b", 2.5), (None, 3.0), ("y", 9.0)], TYPE)
    found = flags(diff(reported, expected, ["k"], "v"))
    assert found == [("b", "changed"), ("x", "extra"), ("y", "missing")]


def test_null_against_zero_and_nan(spark):
    nan = float("nan")
    reported = spark.createDataFrame([("a", None), ("b", nan), ("c", -0.0), ("d", None)], TYPE)
    expected = spark.createDataFrame([("a", 0.0), ("b", nan), ("c", 0.0), ("d", None)], TYPE)
    assert flags(diff(reported, expected, ["k"], "v")) == [("a", "changed")]


def test_tolerance(spark):
    reported = spark.createDataFrame([("in", 1.010), ("out", 1.012), ("null", None)], TYPE)
    expected = spark.createDataFrame([("in", 1.0), ("out", 1.0), ("null", 1.0)], TYPE)
    assert flags(diff(reported, expected, ["k"], "v", eps=0.011)) == [("null", "changed"), ("out", "changed")]
    assert len(flags(diff(reported, expected, ["k"], "v"))) == 3


def test_empty_sides(spark):
    none = spark.createDataFrame([], TYPE)
    some = spark.createDataFrame([("a", 1.0), ("b", 2.0)], TYPE)
    assert flags(diff(none, some, ["k"], "v")) == [("a", "missing"), ("b", "missing")]
    assert flags(diff(some, none, ["k"], "v")) == [("a", "extra"), ("b", "extra")]
    assert flags(diff(none, none, ["k"], "v")) == []


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("eps", [None, 0.6])
def test_repeated_keys_against_all_pairs(spark, seed, eps):
    """A repeated key is flagged exactly when some pair of its rows differs."""
    rng = random.Random(seed)

    def side():
        return [(rng.choice("abcdefgh"), rng.choice([None, 1.0, 1.5, 2.0])) for _ in range(14)]

    left, right = side(), side()

    def pair_differs(a, b):
        if a is None or b is None:
            return (a is None) != (b is None)
        return a != b if eps is None else abs(a - b) > eps

    wanted = []
    for key in sorted({k for k, _ in left + right}):
        mine, theirs = [v for k, v in left if k == key], [v for k, v in right if k == key]
        if not mine:
            wanted.append((key, "missing"))
        elif not theirs:
            wanted.append((key, "extra"))
        elif any(pair_differs(a, b) for a in mine for b in theirs):
            wanted.append((key, "changed"))
    found = diff(spark.createDataFrame(left, TYPE), spark.createDataFrame(right, TYPE), ["k"], "v", eps)
    assert flags(found) == wanted


def test_wide_diff_and_schema_drift(spark):
    reported = spark.createDataFrame([(1, "x", 1, 5)], "k int, a string, b int, extra int")
    expected = spark.createDataFrame([(1, "y", 1, 7)], "k int, a string, b bigint, gone int")
    rows = [(r.flagged_pk, r["column"], r.reported, r.expected) for r in diff_wide(reported, expected, ["k"]).collect()]
    assert rows == [("1", "a", "x", "y")]
    assert schema_diff(reported, expected) == [
        ("b", "retyped", "int", "bigint"), ("extra", "added", "int", None), ("gone", "missing", None, "int"),
    ]


def test_invariant_missing_rows_and_key_gate(spark):
    report = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, None, None), (3, 2.0, 2.0)],
                                   "k int, calc double, ref double")
    assert [r.flagged_pk for r in row_mismatch(report, ["k"], "calc", "ref").collect()] == ["2"]
    source = spark.createDataFrame([(1,), (4,), (None,)], "k int")
    assert sorted(str(r.flagged_pk) for r in missing_rows(source, report, ["k"]).collect()) == ["4", "None"]
    assert [(r.flagged_pk, r.n_rows) for r in repeated_keys(report, ["k"]).collect()] == [("3", 2)]


def test_salted_lookup_with_a_hot_key(spark):
    """One key holds most rows; the salted join gives what the plain join gives, spread out."""
    many = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, F.lit(7)).when(F.col("id") % 30 == 2, F.lit(None)).otherwise(F.col("id")).alias("key")
    )
    one = spark.createDataFrame([(7, 1), (5, 2), (8, 3)], "k long, v int")
    for how in ("left", "inner"):
        plain = many.join(one, F.col("key") == F.col("k"), how).drop("k")
        salted = salted_lookup(many, one, "key", "k", F.col("id"), how)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_fanout_counts_rows_without_making_them(spark):
    rows = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 12)], "report int, key int")
    child = spark.createDataFrame([(10,), (10,), (10,), (12,)], "key int")
    found = fanout_profile(rows, "report", "key", child, "key").collect()
    assert [(r.report_key, r.rows_before, r.rows_after) for r in found] == [(1, 3, 7)]
    assert {r.key: r.copies for r in row_counts(child, "key", "key").collect()} == {10: 3, 12: 1}


def wide_counts(frame):
    return sorted((r.column, r.side, r.n_keys) for r in frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_wide_counts_by_join_equal_those_by_grouping(spark, seed):
    rng = random.Random(seed)

    def side():
        return [(k, rng.choice([None, 1.0, float("nan"), -0.0, 0.0]), rng.choice([None, "", "a", "b"])) for k in range(40) if rng.random() < 0.8]

    left, right = (spark.createDataFrame(side(), "k int, v double, t string") for _ in range(2))
    assert keys_once(left, ["k"]).first().once and keys_once(right, ["k"]).first().once
    by_join = wide_counts(diff_wide_counts(left, right, ["k"], once=True))
    assert by_join == wide_counts(diff_wide_counts(left, right, ["k"]))
    assert {s for _, s, _ in by_join} == {"missing", "extra", "changed"}


def test_keys_once_sees_repeats_and_nulls(spark):
    def once(rows):
        return keys_once(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).first().once

    assert once([(1, 1), (1, 2)]) and once([])
    assert not once([(1, 1), (1, 1)]) and not once([(1, None), (1, 2)])


def test_wide_counts_of_bucketed_reports_sort_no_text_and_move_no_row(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS k", "concat('t', id % 7) AS t")
    names = [f"wide_counts_{tmp_path.name}_{i}".lower() for i in range(2)]
    for name in names:
        rows.write.bucketBy(4, "k").sortBy("k").option("path", str(tmp_path / name)).saveAsTable(name)
    left, right = (spark.table(n) for n in names)
    plan = diff_wide_counts(left, right, ["k"], once=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan
    assert wide_counts(diff_wide_counts(left, right.withColumn("t", F.lit("x")), ["k"], once=True)) == [("t", "changed", 50)]
