"""Field lineage: the closure of a dependency graph and the values along it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.session import shared_dir


def edges(spark: SparkSession, graph: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Dependency edges (field, depends_on) of a declared graph."""
    rows = [(field, source) for field, sources in graph.items() for source in sources]
    return spark.createDataFrame(rows, "field string, depends_on string")


def lineage_closure(graph: DataFrame, fields: DataFrame) -> DataFrame:
    """All direct and indirect inputs of the given fields with their shortest distance.

    The frontier moves one edge a round and keeps what was not reached before, so every pair is met
    once, at its shortest distance, and a cycle ends by itself. What is reached is written to the shared
    folder each round, which cuts the lineage of the loop.
    """
    spark = graph.sparkSession
    root = f"{shared_dir(spark)}/lineage-{uuid.uuid4().hex}"
    step = graph.select("field", "depends_on").distinct()

    def stored(frame: DataFrame, depth: int) -> DataFrame:
        path = f"{root}/{depth}"
        frame.withColumn("depth", F.lit(depth)).write.parquet(path)
        return spark.read.schema("root string, field string, depth int").parquet(path)

    def onward(frontier: DataFrame) -> DataFrame:
        return frontier.join(step, "field").select("root", F.col("depends_on").alias("field")).distinct()

    depth = 1
    frontier = stored(onward(fields.select(F.col("field").alias("root"), "field")), depth)
    reached = frontier
    while not frontier.isEmpty():
        depth += 1
        frontier = stored(onward(frontier).join(reached, ["root", "field"], "left_anti"), depth)
        reached = spark.read.schema("root string, field string, depth int").parquet(*[f"{root}/{d}" for d in range(1, depth + 1)])
    return reached


def field_values(frame: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide rows to (keys, field, value as text); columns the table lacks are left out."""
    present = [n for n in names if n in frame.columns]
    cells = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in present]
    )
    return frame.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.*")
