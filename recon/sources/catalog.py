"""Table inventory, integrity gate and schema catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.operators.reconcile import schema_catalog


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table; each count is answered from file footers."""
    counts = [
        frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def copy_inventory(copies: Mapping[str, DataFrame]) -> DataFrame:
    """Per copied table its columns with their types, in order, and its rows."""
    listed = [
        frame.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(frame.columns)).alias("n_columns"),
            F.lit(", ".join(f"{c} {kind}" for c, kind in frame.dtypes)).alias("columns_text"), "n_rows",
        )
        for name, frame in copies.items()
    ]
    return reduce(DataFrame.unionByName, listed)


def integrity_gate(inventory: DataFrame, min_tables: int = 2) -> DataFrame:
    """One row: number of tables, all rows, and whether the source is usable."""
    totals = inventory.agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("total_rows"))
    return totals.withColumn("usable", (F.col("n_tables") >= min_tables) & (F.col("total_rows") > 0))


def require_usable(tables: Mapping[str, DataFrame], min_tables: int = 2) -> None:
    """Fail the job that is about to read a source that the integrity gate refuses."""
    gate = integrity_gate(table_inventory(tables), min_tables).first()
    if not gate.usable:
        raise ValueError(f"unusable source: {gate.n_tables} tables, {gate.total_rows or 0} rows")


def catalog_frame(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The schema catalogue as a table."""
    return spark.createDataFrame(
        schema_catalog(dict(tables)),
        "table_name string, position int, column_name string, column_type string",
    )


def catalog_text(catalog: DataFrame, limit: int = 24) -> DataFrame:
    """One line per table: its first columns in order, longer lists cut."""
    cells = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    names = F.transform(F.slice("cells", 1, limit), lambda c: c["column_name"])
    cut = F.when(F.size("cells") > limit, ", ...").otherwise("")
    return catalog.groupBy("table_name").agg(cells.alias("cells")).select(
        "table_name", F.concat(F.concat_ws(", ", names), cut).alias("columns_text")
    )
