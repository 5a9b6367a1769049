"""Layer walks: evidence from the reported table back to the staging layers, and its score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.functions.text import row_text

# The weights of a layer walk.
W_RAN, W_FINAL, W_LAYERS = 0.60, 0.25, 0.15


def rendered(frame: DataFrame):
    """The whole row as ``a=1 | b=x``, first fields only."""
    return row_text([(c, F.col(f"`{c}`")) for c in frame.columns])


def first_row_text(frame: DataFrame) -> DataFrame:
    """One sample row of a table, the smallest, as text.

    The smallest row is among those with the smallest first column (null first), so a pass over that column alone
    leaves few rows that are compared whole.
    """
    first = F.col(f"`{frame.columns[0]}`")
    least = frame.agg(F.when(F.count_if(first.isNull()) == 0, F.min(first))).scalar()
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("row")
    fields = [(c, F.col(f"row.`{c}`")) for c in frame.columns]
    return frame.where(first.eqNullSafe(least)).agg(row).select(F.when(F.col("row").isNotNull(), row_text(fields)).alias("evidence"))


def rows_by_key(frame: DataFrame, pk: str, keys: list[str | None]) -> DataFrame:
    """Point lookup of a few keys given as text, pushed into the scan in the key's own type."""
    kind = dict(frame.dtypes)[pk]
    wanted = F.col(pk).isin([F.lit(k).cast(kind) for k in keys if k is not None])
    return frame.filter(wanted | F.col(pk).isNull() if None in keys else wanted)


def suspect_sides(
    keys: list[str | None], reported: DataFrame, expected: DataFrame, pk: str
) -> DataFrame:
    """The suspect rows of one report on both sides: (flagged_pk, is_reported, row_text).

    ``keys`` are the suspects of one report, as many as there are seeds.
    """

    def matching(frame: DataFrame, is_reported: bool) -> DataFrame:
        return rows_by_key(frame, pk, keys).select(
            F.col(pk).cast("string").alias("flagged_pk"),
            F.lit(is_reported).alias("is_reported"),
            rendered(frame).alias("row_text"),
        )

    return matching(reported, True).unionByName(matching(expected, False))


def suspect_rows(sides: DataFrame, by: list[str]) -> DataFrame:
    """The row as reported, or as recomputed when the report lacks it."""
    mine = F.max(F.when(F.col("is_reported"), F.col("row_text")))
    theirs = F.max(F.when(~F.col("is_reported"), F.col("row_text")))
    return sides.groupBy(*by).agg(
        mine.isNull().alias("is_missing"), F.coalesce(mine, theirs).alias("row_text")
    )


def layer_walk_score(walks: DataFrame, layers: DataFrame, walk: list[str]) -> DataFrame:
    """Score each walk against its pipeline.

    ``walks``: position, layer, table, evidence and evidence_pk per step, with the suspect key.
    ``layers``: one row per defect with the expected layers from final to source, the final
    table and the number of steps. A walk has a handful of steps, so each is gathered in one row.
    """
    step = F.struct("position", "layer", "table_name", "evidence", "evidence_pk", "suspect_pk")
    gathered = walks.groupBy(*walk).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    joined = gathered.join(layers, "defect_id")
    ran = F.size(F.filter("steps", lambda s: s["evidence"].isNotNull()))
    head = F.get("steps", 0)
    final_ok = F.coalesce(head["evidence_pk"] == head["suspect_pk"], F.lit(False))
    layers_ok = (
        (F.lower(head["table_name"]) == F.lower("final_table"))
        & (F.size("steps") == F.col("n_steps"))
        & (F.transform("steps", lambda s: s["layer"]) == F.col("expected_layers"))
    )
    score = (
        ran / F.col("n_steps") * F.lit(W_RAN)
        + F.when(final_ok, W_FINAL).otherwise(0.0)
        + F.when(layers_ok, W_LAYERS).otherwise(0.0)
    )
    return joined.select(
        *walk,
        F.size("steps").alias("n_steps"),
        ran.alias("ran"),
        final_ok.alias("final_ok"),
        layers_ok.alias("layers_ok"),
        F.round(F.least(F.lit(1.0), score), 4).alias("score"),
    )
