"""Reconciliation of a reported table with an independent recomputation.

Both sides are tagged, put on top of each other and grouped by key. Compared with a null-safe
full outer join this needs no sort and, where both sides already arrive grouped by the key, no
further shuffle; grouping treats NULL keys as equal; and a repeated key costs a few buffer
values instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.functions.compare import differs, differs_beyond
from recon.functions.text import key_text

MISSING, EXTRA, CHANGED = "missing", "extra", "changed"


def common_columns(reported: DataFrame, expected: DataFrame, keys: Sequence[str]) -> list[str]:
    """Value columns both sides have, in the order of the expected table."""
    present = set(reported.columns)
    return [c for c in expected.columns if c in present and c not in keys]


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def common_type(a: str, b: str) -> str:
    """The type two versions of a column are compared in: numbers as numbers, times as times, else text.

    An exact number next to a double is compared as double, which is all the double can tell.
    """
    if a == b:
        return a
    kinds = {a.split("(")[0], b.split("(")[0]}
    if kinds == {"decimal"}:
        (p, s), (q, t) = ([int(x) for x in k[8:-1].split(",")] for k in (a, b))
        scale = max(s, t)
        return f"decimal({min(38, max(p - s, q - t) + scale)},{scale})"
    if kinds <= {"decimal", *_NUMBERS}:
        if kinds & {"float", "double"}:
            return "double"
        return "bigint" if "decimal" not in kinds else f"decimal(38,{max(int(k[8:-1].split(',')[1]) for k in (a, b) if k.startswith('decimal'))})"
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp"
    return "string"


def _stacked(
    reported: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    kinds = dict(expected.dtypes)
    theirs = dict(reported.dtypes)

    def side(frame: DataFrame, is_reported: bool) -> DataFrame:
        values = []
        for c in columns:
            values.append(F.col(c).cast(common_type(kinds[c], theirs[c])).alias(c))
        return frame.select(*keys, F.lit(is_reported).alias("_reported"), *values)

    return side(reported, True).unionByName(side(expected, False))


def _summaries(columns: Sequence[str]) -> list[Column]:
    mine, theirs = F.col("_reported"), ~F.col("_reported")
    out = [F.count_if(mine).alias("n_reported"), F.count_if(theirs).alias("n_expected")]
    for i, c in enumerate(columns):
        for tag, where in (("r", mine), ("e", theirs)):
            value = F.when(where, F.col(c))
            out += [
                F.min(value).alias(f"_{tag}{i}_min"),
                F.max(value).alias(f"_{tag}{i}_max"),
                F.count(value).alias(f"_{tag}{i}_n"),
            ]
    return out


def _column_differs(i: int, eps: float | None) -> Column:
    """Whether any reported value of the key differs from any expected one."""
    r_min, r_max, r_n = (F.col(f"_r{i}_{s}") for s in ("min", "max", "n"))
    e_min, e_max, e_n = (F.col(f"_e{i}_{s}") for s in ("min", "max", "n"))
    partly_null = ((r_n > 0) & (r_n < F.col("n_reported"))) | (
        (e_n > 0) & (e_n < F.col("n_expected"))
    )
    if eps is None:
        spread = differs(r_min, r_max) | differs(r_min, e_min) | differs(r_max, e_max)
    else:
        spread = differs_beyond(r_min, e_max, eps) | differs_beyond(r_max, e_min, eps)
    return partly_null | spread


def _side(changed: Column) -> Column:
    return (
        F.when(F.col("n_reported") == 0, F.lit(MISSING))
        .when(F.col("n_expected") == 0, F.lit(EXTRA))
        .when(changed, F.lit(CHANGED))
    )


def diff(
    reported: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    column: str,
    eps: float | None = None,
) -> DataFrame:
    """Keys whose row is missing, extra, or has another value in ``column``.

    Exact by default; with ``eps`` two present values may be that far apart. Output: the keys,
    ``flagged_pk``, ``side``, ``reported``, ``expected`` and the row count per side, so repeated
    keys show up as counts above one.
    """
    grouped = _stacked(reported, expected, keys, [column]).groupBy(*keys).agg(*_summaries([column]))
    flagged = grouped.withColumn("side", _side(_column_differs(0, eps))).filter("side IS NOT NULL")
    return flagged.select(
        *keys,
        key_text(keys).alias("flagged_pk"),
        "side",
        F.col("_r0_max").alias("reported"),
        F.col("_e0_max").alias("expected"),
        "n_reported",
        "n_expected",
    )


def diff_many(
    pairs: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str], str]], name: str, kind: str,
    plain: Mapping[str, tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """The exact diffs of many pairs of tables in one frame.

    ``pairs``: name of the pair to (reported, expected, keys, compared column). The columns are compared as
    ``kind``, which must hold their values exactly. Each side becomes one row per key and the two are joined, so a
    pair that lies bucketed by its keys is not shuffled, and keys are rendered for flagged rows only. Rows with a
    null in their key, which no join on equal keys matches, are grouped by the rendered key, those of all pairs in
    one grouping; they are sought in ``plain`` where it has the same two tables in another layout. Output: ``name``,
    ``flagged_pk``, ``side``, ``reported``, ``expected``.
    """
    value = F.col("_value")
    told = {"rows": F.count("*"), "min": F.min(value), "max": F.max(value), "n": F.count(value)}
    found, unkeyed = [], []
    for pair, (reported, expected, keys, column) in pairs.items():
        summed = []
        for frame, same, tag in zip((reported, expected), (plain or {}).get(pair, (reported, expected)), "re"):
            valued, sought = (f.select(*keys, F.col(column).cast(kind).alias("_value")) for f in (frame, same))
            whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            summed.append(valued.where(whole).groupBy(*keys).agg(*[c.alias(f"_{tag}0_{n}") for n, c in told.items()]))
            unkeyed.append(sought.where(~whole).select(
                F.lit(pair).alias(name), key_text(keys).alias("flagged_pk"), F.lit(tag == "r").alias("_reported"), "_value"))
        found.append(summed[0].join(summed[1], list(keys), "full").select(
            F.lit(pair).alias(name), key_text(keys).alias("flagged_pk"), *[
                F.col(c) for side in summed for c in side.columns if c.startswith(("_r0", "_e0"))]).withColumns(
            {"n_reported": F.coalesce("_r0_rows", F.lit(0)), "n_expected": F.coalesce("_e0_rows", F.lit(0)),
             "_r0_n": F.coalesce("_r0_n", F.lit(0)), "_e0_n": F.coalesce("_e0_n", F.lit(0))}).drop("_r0_rows", "_e0_rows"))
    found.append(reduce(DataFrame.unionByName, unkeyed).groupBy(name, "flagged_pk").agg(*_summaries(["_value"])))
    return reduce(DataFrame.unionByName, found).withColumn("side", _side(_column_differs(0, None))).filter("side IS NOT NULL").select(
        name, "flagged_pk", "side", F.col("_r0_max").alias("reported"), F.col("_e0_max").alias("expected")
    )


def diff_wide(
    reported: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    eps: float | None = None,
) -> DataFrame:
    """The same for all common columns, one row per key and differing column.

    A missing or extra row appears once per compared column. Values are rendered as text.
    """
    compared = list(columns or common_columns(reported, expected, keys))
    grouped = _stacked(reported, expected, keys, compared).groupBy(*keys).agg(*_summaries(compared))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                _side(_column_differs(i, eps)).alias("side"),
                F.col(f"_r{i}_max").cast("string").alias("reported"),
                F.col(f"_e{i}_max").cast("string").alias("expected"),
            )
            for i, c in enumerate(compared)
        ]
    )
    found = F.filter(cells, lambda cell: cell["side"].isNotNull())
    return grouped.select(key_text(keys).alias("flagged_pk"), F.explode(found).alias("cell")).select(
        "flagged_pk", "cell.*"
    )


def keys_once(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, ``once``: whether no key is null or held by more than one row."""
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counts = frame.groupBy(*keys).agg(F.count("*").alias("_n")).select(F.when(unkeyed, 2).otherwise(F.col("_n")).alias("_n"))
    return counts.agg((F.coalesce(F.max("_n"), F.lit(0)) < 2).alias("once"))


def diff_wide_counts(reported: DataFrame, expected: DataFrame, keys: Sequence[str], once: bool = False) -> DataFrame:
    """How many keys ``diff_wide`` flags, by column and side: (column, side, n_keys), none without keys.

    With ``once`` the caller states what ``keys_once`` tells of both sides. The rows of a key are then joined and
    compared as they are: summing up text in a grouping means sorting and no generated code, and neither is
    needed here, nor is an exchange where both sides lie bucketed by their keys.
    """
    if not once:
        return diff_wide(reported, expected, keys).groupBy("column", "side").agg(F.count("*").alias("n_keys"))
    compared = common_columns(reported, expected, keys)
    kinds, theirs = dict(expected.dtypes), dict(reported.dtypes)

    def side(frame: DataFrame, tag: str) -> DataFrame:
        values = [F.col(c).cast(common_type(kinds[c], theirs[c])).alias(f"_{tag}{i}") for i, c in enumerate(compared)]
        return frame.select(*keys, F.lit(True).alias(f"_{tag}"), *values)

    both = side(reported, "r").join(side(expected, "e"), list(keys), "full")
    missing, extra = F.col("_r").isNull(), F.col("_e").isNull()
    counts = [F.count_if(missing).alias("_missing"), F.count_if(extra).alias("_extra")]
    counts += [F.count_if(~missing & ~extra & differs(F.col(f"_r{i}"), F.col(f"_e{i}"))).alias(f"_n{i}") for i in range(len(compared))]
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(label).alias("side"), F.col(n).alias("n_keys"))
        for i, c in enumerate(compared) for label, n in ((MISSING, "_missing"), (EXTRA, "_extra"), (CHANGED, f"_n{i}"))
    ]
    return both.agg(*counts).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("n_keys > 0")


def repeated_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-uniqueness gate: keys held by more than one row, with their row count."""
    counts = frame.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return counts.filter("n_rows > 1").select(key_text(keys).alias("flagged_pk"), "n_rows")


def row_mismatch(
    report: DataFrame,
    keys: Sequence[str],
    calc: str,
    ref: str,
    eps: float | None = None,
) -> DataFrame:
    """Row invariant: keys whose calculated value disagrees with the reference beside it."""
    left, right = F.col(calc), F.col(ref)
    bad = differs(left, right) if eps is None else differs_beyond(left, right, eps)
    return report.filter(bad).select(key_text(keys).alias("flagged_pk"))


def missing_rows(source: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source keys that never reached the report, with the number of source rows they have.

    The source is reduced to its keys first: the aggregate uses the partitioning the join needs
    anyway, and a key held by very many rows reaches the join as one row.
    """
    held = source.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    missing = held.join(report.select(*keys), list(keys), "left_anti")
    return missing.select(key_text(keys).alias("flagged_pk"), "n_rows")


def schema_catalog(frames: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(table, position, column, type) of every visible table; names starting zz_ are hidden."""
    rows = []
    for table in sorted(t for t in frames if not t.startswith("zz_")):
        for position, (column, kind) in enumerate(frames[table].dtypes, start=1):
            rows.append((table, position, column, kind))
    return rows


def schema_diff(reported: DataFrame, expected: DataFrame) -> list[tuple[str, str, str, str]]:
    """(column, change, reported type, expected type) for columns missing, added or retyped."""
    mine, theirs = dict(reported.dtypes), dict(expected.dtypes)
    rows = []
    for column in sorted({*mine, *theirs}):
        if column not in mine:
            rows.append((column, "missing", None, theirs[column]))
        elif column not in theirs:
            rows.append((column, "added", mine[column], None))
        elif mine[column] != theirs[column]:
            rows.append((column, "retyped", mine[column], theirs[column]))
    return rows
