"""Joins that multiply rows: how much, for which keys, and the repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.functions.exact import times
from recon.operators.joins import row_counts, salted_lookup


def fanout_profile(
    rows: DataFrame, report_key: str, join_key: str, child: DataFrame, child_key: str
) -> DataFrame:
    """Rows per reported key before and after left-joining ``child``.

    The multiplied rows are never produced: the child is reduced to a count per key, and the
    rows to a count per (reported key, join key).
    """
    before = rows.groupBy(
        F.col(report_key).alias("report_key"), F.col(join_key).alias("join_key")
    ).agg(F.count("*").alias("n"))
    copies = row_counts(child, child_key, "child_key")
    joined = salted_lookup(before, copies, "join_key", "child_key", F.col("report_key"))
    return (
        joined.groupBy("report_key")
        .agg(
            F.sum("n").alias("rows_before"),
            F.sum(F.col("n") * times(F.col("copies"))).alias("rows_after"),
        )
        .filter("rows_after > rows_before")
        .withColumn("ratio", F.round(F.col("rows_after") / F.col("rows_before"), 4))
    )


def max_per_key(child: DataFrame, key: str, value: str) -> DataFrame:
    """The repair: one row per key holding the largest value, ready to be joined safely."""
    return child.groupBy(key).agg(F.max(value).alias(value))
