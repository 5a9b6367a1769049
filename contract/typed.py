"""Output types both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(frame: DataFrame) -> DataFrame:
    """Decimals to double, integers to long, times to ISO dates; all at the very end."""
    out = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            column = F.date_format(column, "yyyy-MM-dd")
        out.append(column.alias(field.name))
    return frame.select(*out)
