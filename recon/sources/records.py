"""Records of delimited files whose quoted fields may hold line breaks, without giving up file splits.

Whether a line starts inside a quoted field depends on all text before it. But there are only two states, so a
file split can be read for both: the first pass gives, per split, the state it ends in if it starts outside and if
it starts inside quotes. A running composition over the splits of a file (one row a split) yields the true state at
every split's start, and the second pass cuts records from there. What a split holds of a record that began
earlier, or that goes on in the next one, is a fragment; fragments of one record are put together by the split the
record began in. Whole records, nearly all rows, are never shuffled.

Quotes count as such at the start of a field only; within quotes a doubled quote is a quote; text after a closing
quote belongs to the field. A record ends at a line feed outside quotes; a carriage return before it is dropped,
within quotes both stay. Blank lines between records are skipped. An opening quote that is never closed makes the
rest of its file one record. A record of more than ``most_bytes`` is an error that names its file and split.
Compressed files that cannot be split are one split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
MOST_RECORD_BYTES = 64 << 20

_PASS = "path string, start bigint, from_out boolean, from_in boolean"
_CUT = "path string, start bigint, kind int, ends boolean, record string"
_WHOLE, _HEAD, _TAIL = 0, 1, 2


class _Lines:
    """Whether a line leaves quotes open, from either state."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        quoted = rf'"(?:[^"]++|"")*+"[^{s}]*+'
        cell = rf'(?:{quoted}|[^"{s}][^{s}]*+|)'
        self._closed = re.compile(rf"{cell}(?:{s}{cell})*+", re.DOTALL)
        self._closing = re.compile(rf'(?:[^"]++|"")*+"[^{s}]*+(?:{s}{cell})*+', re.DOTALL)

    def open_after(self, line: str, inside: bool) -> bool:
        if QUOTE not in line:
            return inside
        return not (self._closing if inside else self._closed).fullmatch(line)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str | None], list[int]]]:
    """(path, split start, lines, places of lines with quotes) of consecutive rows of one split."""
    for batch in batches:
        lines, paths, starts = batch.column("value"), batch.column("path"), batch.column("start")
        at = 0
        while at < batch.num_rows:
            path, start = paths[at].as_py(), starts[at].as_py()
            same = pc.and_(pc.equal(paths.slice(at), path), pc.equal(starts.slice(at), start))
            last = pc.index(same, False).as_py()
            upto = batch.num_rows if last < 0 else at + last
            run = lines.slice(at, upto - at)
            marked = pc.indices_nonzero(pc.match_substring(run, QUOTE)).to_pylist()
            yield path, start, run.to_pylist(), marked
            at = upto


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def split_states(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One row per split: (path, start, from_out, from_in, inside): its end states, and whether it starts inside."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, at, out, within = _Lines(sep), None, False, True
        for path, start, lines, marked in _runs(batches):
            if (path, start) != at:
                if at is not None:
                    yield _row(_PASS_SCHEMA, *at, out, within)
                at, out, within = (path, start), False, True
            for i in marked:
                out, within = rules.open_after(lines[i], out), rules.open_after(lines[i], within)
        if at is not None:
            yield _row(_PASS_SCHEMA, *at, out, within)

    splits = _split_lines(spark, path).mapInArrow(survey, _PASS)
    in_file = Window.partitionBy("path").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    counted = splits.withColumn("_turns", F.sum(turns.cast("int")).over(in_file))
    # The state at a split's start: that of the last split that fixes it, turned as often as splits since do.
    since = F.coalesce(F.last("_turns", True).over(before), F.lit(0)) - F.coalesce(
        F.last(F.when(fixed, F.col("_turns")), True).over(before), F.lit(0))
    held = F.coalesce(F.last(F.when(fixed, F.col("from_out")), True).over(before), F.lit(False))
    return counted.withColumn("inside", held != (since % 2 == 1)).drop("_turns")


_PASS_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())])
_CUT_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("ends", pa.bool_()), ("record", pa.string())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def records(spark: SparkSession, path: str, sep: str = ",", most_bytes: int = MOST_RECORD_BYTES) -> DataFrame:
    """(record) of every record of the files at ``path``, unparsed, blank ones left out."""
    # Only splits that start inside quotes are named, at most one row a split.
    inside = {(r.path, r.start) for r in split_states(spark, path, sep).where("inside").select("path", "start").collect()}
    shared = spark.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, at, open_, held, head = _Lines(sep), None, False, [], False

        def too_long() -> None:
            if sum(map(len, held)) > most_bytes:
                raise ValueError(f"a record of more than {most_bytes} bytes in {at[0]}, split at {at[1]}")

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                yield _row(_CUT_SCHEMA, *at, _HEAD if head else _TAIL, False, "\n".join(held))

        for path, start, lines, marked in _runs(batches):
            if (path, start) != at:
                if at is not None:
                    yield from finish()
                at, held = (path, start), []
                open_ = head = at in shared.value
            whole, done = [], 0
            for i in marked:
                after = rules.open_after(lines[i], open_)
                if open_:
                    held += lines[done: i + 1]
                    done = i + 1
                    if not after:
                        text = "\n".join(held)
                        if head:
                            yield _row(_CUT_SCHEMA, *at, _HEAD, True, text)
                        else:
                            whole.append(text)
                        held, head = [], False
                elif after:
                    whole += lines[done:i]
                    held, done = [lines[i]], i + 1
                open_ = after
                if held:
                    too_long()
            if open_:
                held += lines[done:]
                too_long()
            else:
                whole += lines[done:]
            whole = [w[:-1] if w.endswith("\r") else w for w in whole]
            whole = [w for w in whole if w.strip()]
            if whole:
                n = len(whole)
                yield pa.RecordBatch.from_arrays([
                    pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array([_WHOLE] * n, pa.int32()),
                    pa.array([True] * n), pa.array(whole, pa.string())], schema=_CUT_SCHEMA)
        if at is not None:
            yield from finish()

    parts = _split_lines(spark, path).mapInArrow(cut, _CUT)
    whole = parts.where(F.col("kind") == _WHOLE).select("record")
    if not inside:
        # No record crosses a split; one that its file never closes is a tail of its own.
        return whole.unionByName(parts.where(F.col("kind") == _TAIL).select("record"))
    before = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    pieces = parts.where(F.col("kind") != _WHOLE).withColumn(
        "began", F.last(F.when(F.col("kind") == _TAIL, F.col("start")), True).over(before))
    pieces = pieces.withColumn("began", F.when(F.col("kind") == _TAIL, F.col("start")).otherwise(F.col("began")))
    joined = pieces.groupBy("path", "began").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.unionByName(joined.select(F.regexp_replace(text, r"\r$", "").alias("record")))
