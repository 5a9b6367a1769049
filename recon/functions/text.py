"""Text columns: key rendering, row rendering, stable ordering, quoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(keys: Sequence[str]) -> Column:
    """The reported key as text. A single NULL key stays NULL.

    The parts of a composite key are joined by a colon; a colon or backslash within a part is escaped, and
    a part that is NULL reads \\N, so different keys have different texts.
    """
    parts = [F.col(k).cast("string") for k in keys]
    if len(parts) == 1:
        return parts[0]
    parts = [F.coalesce(F.regexp_replace(p, r"([\\:])", r"\\$1"), F.lit("\\N")) for p in parts]
    spaced = [parts[0]]
    for part in parts[1:]:
        spaced += [F.lit(":"), part]
    return F.concat(*spaced)


def stable_order(seed: Column, key: Column) -> Column:
    """An order that looks random, depends only on seed and key, and is the same everywhere."""
    return F.md5(F.concat_ws(":", seed.cast("string"), key).cast("binary"))


def field_text(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("None")))


def integral_text(value: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    whole = value.cast("decimal(38,0)")
    return F.when(value == F.floor(value), whole.cast("string")).otherwise(value.cast("string"))


def row_text(columns: Sequence[tuple[str, Column]], limit: int | None = None) -> Column:
    """``a=1 | b=x`` for all fields of a row, or the first ``limit``."""
    return F.concat_ws(" | ", *[field_text(n, c) for n, c in list(columns)[:limit]])


def sql_literal(value: Column) -> Column:
    """A text value quoted for use inside a query."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull() | (F.upper(value) == "NULL"), F.lit("NULL")).otherwise(quoted)
