"""Many rows of one key as one text, in their order, without holding the rows of a key together.

Rows are put in order by ranges of (key, sequence), so one key may span many tasks; each task renders what it
passes and joins it to runs of bounded length as it goes. A key's text is then put together from its runs, of
which there are thousands of times fewer than rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.functions.text import row_text

#: Characters after which a run is closed.
RUN_CHARS = 1 << 16
JOINER = "\n  "


def panel_runs(
    frame: DataFrame, key: str, order: Sequence[str], fields: Sequence[tuple[str, Column]], joiner: str = JOINER,
    run_chars: int = RUN_CHARS,
) -> DataFrame:
    """(key, run, n_rows, text): the rendered rows of each key in order, cut into runs numbered upwards.

    Rows with equal ``order`` come in the order of their text; nulls first. The numbers of a key's runs rise, with
    gaps. A null key is a key.
    """
    rows = frame.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row_text(fields).alias("line"))
    by = ["key", *[f"o{i}" for i in range(len(order))], "line", "row"]
    # Equal rows are told apart, so that any key can be cut anywhere.
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    kind = rows.schema["key"].dataType

    def join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, held, size, run = ("key", "part", "run", "n_rows", "text"), None, [], 0, 0

        def closed(key_array, part: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [key_array, pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([len(held)], pa.int64()),
                 pa.array([joiner.join(held)], pa.string())], names=list(names))

        for batch in batches:
            keys, lines, part = batch.column("key"), batch.column("line").to_pylist(), batch.column("part")
            values = keys.to_pylist()
            for i, value in enumerate(values):
                if held and (value != now[0] or size > run_chars):
                    yield closed(now[1], now[2])
                    held, size, run = [], 0, run + 1
                if not held:
                    now = (value, keys.slice(i, 1), part[i].as_py())
                held.append(lines[i])
                size += len(lines[i]) + len(joiner)
        if held:
            yield closed(now[1], now[2])

    runs = dealt.withColumn("part", F.spark_partition_id()).select("key", "part", "line").mapInArrow(
        join_rows, f"key {kind.simpleString()}, part int, run bigint, n_rows bigint, text string")
    return runs.select(F.col("key").alias(key), (F.shiftleft(F.col("part").cast("bigint"), 40) + F.col("run")).alias("run"), "n_rows", "text")


def panel_text(
    frame: DataFrame, key: str, order: Sequence[str], fields: Sequence[tuple[str, Column]], joiner: str = JOINER,
    run_chars: int = RUN_CHARS,
) -> DataFrame:
    """(key, n_rows, panel): one text per key, its rendered rows in order."""
    runs = panel_runs(frame, key, order, fields, joiner, run_chars)
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    return runs.groupBy(key).agg(
        F.sum("n_rows").alias("n_rows"), F.array_join(F.transform(parts, lambda p: p["text"]), joiner).alias("panel"))
