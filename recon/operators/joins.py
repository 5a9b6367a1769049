"""Join helpers for keys of unknown skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(
    many: DataFrame,
    one: DataFrame,
    many_key: str,
    one_key: str,
    spread_by: Column,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Look up one row per key for rows whose key may be very frequent.

    ``one`` must hold at most one row per key, normally the output of an aggregation. Each of
    its rows is repeated once per salt, and the rows of ``many`` are spread over the salts by
    ``spread_by``, so a key holding a third of all rows is split over ``salts`` tasks. The
    shuffle on (key, salt) sits right below the join, which lets adaptive execution split
    further. ``one_key`` is dropped from the result.
    """
    spread = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = one.withColumnRenamed(one_key, "_key").withColumn(
        "_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    condition = (F.col(many_key) == F.col("_key")) & (F.col("_salt") == F.col("_salt_of"))
    return spread.join(repeated, condition, how).drop("_key", "_salt", "_salt_of")


def row_counts(frame: DataFrame, key: str, alias: str, count: str = "copies") -> DataFrame:
    """How many rows each key has: stands in for a child table that only multiplies rows."""
    return frame.groupBy(F.col(key).alias(alias)).agg(F.count("*").alias(count))
