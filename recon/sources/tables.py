"""Source databases: one folder of Parquet files, one DataFrame per table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class SourceTables(Mapping[str, DataFrame]):
    """Read-only mapping of table name to a lazily opened Parquet scan."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._names = names
        self._schemas: dict[str, StructType] = {}
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            reader = self.spark.read
            if name in self._schemas:
                reader = reader.schema(self._schemas[name])
            self._open[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def in_session(self, spark: SparkSession) -> SourceTables:
        """The same tables opened by another session, without reading their footers again."""
        other = SourceTables(spark, self.folder, self._names)
        other._schemas = {name: self[name].schema for name in self}
        return other

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def register_views(self) -> None:
        """Expose every table under its own name to ``spark.sql``."""
        for name in self:
            self[name].createOrReplaceTempView(name)
