"""Delimited-text loads with declared types and an account of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.sources.records import records

BAD_ROW = "_bad_row"


@dataclass(frozen=True)
class Loaded:
    """Accepted rows, and the raw text of the refused ones beside their first field."""

    rows: DataFrame
    dropped: DataFrame


def load_csv_checked(
    spark: SparkSession, path: str, columns: T.StructType, sep: str = ",", row_filter: Column | None = None
) -> Loaded:
    """CSV (plain or gzip) with a fixed column list; rows with another field count are refused.

    A row with a wrong number of fields or a value that does not fit its declared type lands in
    ``dropped`` whole. Quoted fields may hold line breaks, separators and doubled quotes. Records are
    parsed as a column, so the field count is checked whichever columns are used later.
    """
    with_bad = T.StructType([*columns.fields, T.StructField(BAD_ROW, T.StringType())])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_bad.fields)
    lines = records(spark, path, sep).withColumnRenamed("record", "value")
    read = lines.select("value", F.from_csv("value", ddl, options).alias("row"))
    good = read.filter(F.col(f"row.{BAD_ROW}").isNull()).select("row.*").drop(BAD_ROW)
    if row_filter is not None:
        good = good.filter(row_filter)
    refused = read.filter(F.col(f"row.{BAD_ROW}").isNotNull())
    return Loaded(good, refused.select(F.col("value").alias(BAD_ROW), f"row.{columns.fieldNames()[0]}"))


def load_tsv_padded(
    spark: SparkSession, path: str, columns: T.StructType, null_token: str = "\\N", sep: str = "\t"
) -> DataFrame:
    """TSV with a null token: blank lines skipped, short rows padded with NULL, long rows cut.

    A value that does not fit its declared type becomes NULL.
    """
    fields = F.split(F.col("value"), sep, -1)
    lines = spark.read.text(path).filter(F.trim("value") != "").select(fields.alias("f"))
    out = []
    for i, field in enumerate(columns.fields):
        text = F.get("f", F.lit(i))
        kept = F.when((text == null_token) | (text == ""), F.lit(None)).otherwise(text)
        out.append(kept.try_cast(field.dataType).alias(field.name))
    return lines.select(*out)


def typed_copy(frame: DataFrame) -> DataFrame:
    """Decimals to double, times to ISO text: the portable types of an exchange copy."""
    out = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(field.name))
    return frame.select(*out)


def subset_semi(
    parent: DataFrame, keep: Column, children: dict[str, tuple[DataFrame, str]], key: str
) -> dict[str, DataFrame]:
    """Filter the parent and keep only child rows whose key survived.

    ``children`` maps a name to (table, its key column).
    """
    kept = parent.filter(keep)
    keys = kept.select(F.col(key).alias("_kept"))
    out = {"parent": kept}
    for name, (child, child_key) in children.items():
        out[name] = child.join(keys, F.col(child_key) == F.col("_kept"), "left_semi")
    return out


def suspect_list(spark: SparkSession, path: str, flag: str = "FLAG", marked: str = "DUDA") -> DataFrame:
    """Rows marked for investigation in a delimited export with a header row; blank rows dropped."""
    listed = spark.read.option("header", True).csv(path).dropna(how="all")
    return listed.filter(F.col(flag) == marked)
