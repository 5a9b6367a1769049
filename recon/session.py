"""Spark session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"

# Adaptive execution re-plans joins from real sizes and splits hot partitions; the forced
# variant accepts one more shuffle rather than leave a hot key in a single task.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "recon", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with adaptive execution on and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**ADAPTIVE, "spark.sql.session.timeZone": "UTC", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Where the session names none, a temporary folder is set in local mode, as in tests. Executors of a
    cluster could not see it, so there it is an error.
    """
    named = spark.conf.get(SHARED_DIR_KEY, None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SHARED_DIR_KEY} must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="recon-shared-")
        spark.conf.set(SHARED_DIR_KEY, named)
    return named.rstrip("/")
