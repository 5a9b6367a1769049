"""Written intermediate tables, shared by many queries of one application.

Reports, traps and flagged keys feed dozens of later questions. Each is written once to the
shared folder, which also cuts its lineage: a lost executor re-reads files, it does not re-run
the pipeline behind them.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from recon.session import shared_dir

#: Jobs at a time, and jobs of tables with many buckets. The driver holds plans, generated code, threads and task states of each,
#: and a job of many tasks fills the cluster by itself: the second one is there for its last tasks.
CONCURRENT_WRITES, CONCURRENT_LARGE = 4, 2
#: Buckets that a session's shuffle partitions may ask for; more are for sources that are large enough. A bucket is a task of
#: every read and write of a table, and the driver remembers each task of an application.
ASKED_BUCKETS = 256
#: Bytes of the largest source that one bucket stands for.
BUCKET_BYTES = 32 << 20
#: Rows of a file, where the work on a row outweighs its reading. Spark deals files to tasks by bytes, the largest first, but
#: counts at least 4 MB a file: with even, small files a task gets a bounded number of rows, however well these pack.
FILE_ROWS = 32_768
#: Tables are written once and read a few times, so they are packed tightly.
CODEC = {"compression": "zstd"}


class TableStore:
    """Write-once tables under a folder of their own in the shared directory."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/recon-{uuid.uuid4().hex}"
        self._written: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self._lock = threading.Lock()
        self._kept: dict[str, object] = {}
        self.buckets = 0

    def location(self, name: str) -> str:
        return f"{self.root}/{name}"

    def size_buckets(self, largest: DataFrame) -> None:
        """Choose how many buckets tables have, from the bytes of the largest source; all have as many."""
        if not self.buckets:
            size = int(largest._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
            most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = max(1, min(most, max(min(least, ASKED_BUCKETS), -(-size // BUCKET_BYTES))))

    def workers(self) -> ThreadPoolExecutor:
        """Threads that write tables side by side, as many as the driver should plan and watch at once."""
        large = self.buckets > 4 * self.spark.sparkContext.defaultParallelism
        return ThreadPoolExecutor(CONCURRENT_LARGE if large else CONCURRENT_WRITES)

    def table(self, name: str, build: Callable[[], DataFrame], keys: tuple[str, ...] = (), file_rows: int = 0) -> DataFrame:
        """Return table ``name``, writing it first if this store has not seen it; ``file_rows`` bounds the rows of a file.

        With ``keys`` it is bucketed by them and sorted within buckets, one file a bucket, so that joins and
        groupings by these keys need no exchange. Only for keys of which none holds many rows.
        """
        with self._lock:
            lock = self._locks[name]
        with lock:
            if name not in self._written:
                path = self.location(name)
                frame = build()
                if keys and self.buckets:
                    entry = f"recon_{self.root.rsplit('-', 1)[1]}_{name}".lower()
                    (frame.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys)
                     .options(**CODEC).option("path", path).saveAsTable(entry))
                    self._written[name] = self.spark.table(entry)
                else:
                    frame.write.options(**CODEC, maxRecordsPerFile=file_rows).parquet(path)
                    self._written[name] = self.spark.read.schema(frame.schema).parquet(path)
            return self._written[name]

    def parts(self, name: str, builds: Mapping[str, Callable[[], DataFrame]], file_rows: int = 0) -> DataFrame:
        """Table ``name``, the rows of all ``builds``, each of which is written by a job of its own.

        The driver keeps a number for every task and metric of a running stage, so one job over n tables costs it n times
        the metrics of one and n times the tasks. All builds give the same columns.
        """
        with self._lock:
            lock = self._locks[name]
        with lock:
            if name not in self._written:

                def write(part: str) -> StructType:
                    frame = builds[part]()
                    frame.write.options(**CODEC, maxRecordsPerFile=file_rows).parquet(f"{self.location(name)}/{part}")
                    return frame.schema

                with self.workers() as pool:
                    schemas = list(pool.map(write, builds))
                if len({tuple((f.name, f.dataType) for f in s) for s in schemas}) != 1:
                    raise ValueError(f"the parts of {name} have different columns")
                self._written[name] = self.spark.read.schema(schemas[0]).parquet(*[f"{self.location(name)}/{p}" for p in builds])
            return self._written[name]

    def files(self, name: str) -> DataFrame:
        """A written table read by its files, without its buckets: for lookups, which want few tasks."""
        return self.spark.read.schema(self._written[name].schema).parquet(self.location(name))

    def names(self) -> tuple[str, ...]:
        """The tables written so far."""
        return tuple(self._written)

    def once(self, name: str, build: Callable[[], object]) -> object:
        """An object kept for as long as the store."""
        with self._lock:
            if name not in self._kept:
                self._kept[name] = build()
            return self._kept[name]

    def tables(self, builds: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Several independent tables, their jobs submitted side by side."""
        with self.workers() as pool:
            jobs = {name: pool.submit(self.table, name, build) for name, build in builds.items()}
            return {name: job.result() for name, job in jobs.items()}

    def path(self, name: str) -> str:
        """A fresh location in the store for files in another format."""
        return f"{self.root}/files-{name}-{uuid.uuid4().hex[:8]}"


_STORES: dict[tuple[str, str], TableStore] = {}


def store_for(spark: SparkSession, scope: str) -> TableStore:
    """The store of one (application, scope) pair; scope is usually the source folder."""
    key = (spark.sparkContext.applicationId, scope)
    if key not in _STORES:
        _STORES[key] = TableStore(spark)
    return _STORES[key]
