"""Helpers the operators share: opening tables, written intermediates, bounded slices of a batch."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_KEY = "spark.checkpoint.dir"
#: Bytes of text one step of a Python task works on; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which executors and driver share.

    Where the session names none, a temporary folder is taken in local mode, as in tests; on a
    cluster executors could not see it, so that is an error.
    """
    root = spark.conf.get(SHARED_DIR_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{SHARED_DIR_KEY} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="recon-llm-")
        spark.conf.set(SHARED_DIR_KEY, root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and it is computed once."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, a null text as the empty one; whatever other columns there are go."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see: crc32 of the id as text leaves 0 modulo 5 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def release() -> None:
    """Give memory that finished work has freed back to the system; a Python worker waits for its next task else with all it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def slices(batches, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each cut has about ``limit`` bytes, one row at least."""
    try:
        yield from _cuts(batches, limit, column)
    finally:
        release()


def _cuts(batches, limit: int, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        array = batch.column(column)
        ends = array.cast(pa.large_string()) if pa.types.is_string(array.type) else array
        sizes = pc.binary_length(ends).fill_null(0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and wherever ``use`` names it.

    An expression named inside a lambda is otherwise computed anew for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def fits(frame: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; reads no more of it than that needs."""
    return frame.limit(rows + 1).count() <= rows


def bounded_sample(rows: DataFrame, limit: int, salt: int) -> DataFrame:
    """All rows, or about ``limit`` of them by a hash of doc_id, which is uniform over 64 bits."""
    total = rows.count()
    if total <= limit:
        return rows
    return rows.where(F.xxhash64("doc_id", F.lit(salt)) < F.lit(int(limit / total * 2**64) - 2**63))
