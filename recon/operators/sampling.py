"""Seeds, deterministic samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.functions.text import stable_order
from recon.operators.joins import salted_lookup
from recon.sources.store import TableStore

# The seed grid and the size of a planted sample.
SEED_START, SEED_PER_CLASS, SEED_PER_EPISODE = 9001, 10_007, 911
PLANTED = 3
# One key in so many gives the bound of a sample, and the digest that no key exceeds.
BOUND_ROWS, NO_BOUND = 1_024, "g"
TEST_SHARE = 0.2
# Blocks of a numbered group: rows each, and the most leading digits of the order that name one.
BLOCK_ROWS, MOST_DIGITS = 2_000, 3
# Digits of the order by which a selection refines a range, and the range it need not refine.
RANGE_DIGITS, SMALL_RANGE = 3, 4_096


def seed_grid(
    classes: DataFrame,
    per_class: int,
    start: int = SEED_START,
    by_class: int = SEED_PER_CLASS,
    by_episode: int = SEED_PER_EPISODE,
) -> DataFrame:
    """One row per (class, episode number); ``class_index`` gives the class its seeds."""
    episode = F.explode(F.sequence(F.lit(0), F.lit(per_class - 1)))
    return classes.withColumn("episode", episode).withColumn(
        "seed",
        (F.lit(start) + F.col("class_index") * by_class + F.col("episode") * by_episode).cast("bigint"),
    )


def sample_keys(flagged: DataFrame, seeds: DataFrame, group: str, k: int = PLANTED) -> DataFrame:
    """The first ``k`` flagged keys per (group, seed) in stable order: (group, seed, rank, flagged_pk).

    Two passes over the keys. One in BOUND_ROWS of them, chosen by a hash, gives each (group, seed) a bound: the
    ``k``-th smallest digest of some of its keys, which that of all of them cannot exceed. Then every key is judged,
    and those within the bound, about ``k`` times BOUND_ROWS a group and seed, are ranked; a group with too few
    chosen keys has no bound and is ranked whole. ``seeds`` are parameters, of a size that does not grow with the
    data, and travel with their bounds as literals, so no row of keys times seeds is shuffled. Keys are text; a repeated key takes a
    place for each of its rows, a null key has a place of its own in the order, groups without seeds or keys give no row.
    """
    of: dict[object, dict[int, str]] = {}
    for row in seeds.select(group, "seed").distinct().collect():  # the grid of parameters
        of.setdefault(row[group], {})[row["seed"]] = NO_BOUND
    keys = flagged.select(group, F.col("flagged_pk").cast("string"))
    chosen = keys.where(F.pmod(F.xxhash64("flagged_pk"), F.lit(BOUND_ROWS)) == 0)
    for row in _ranked(chosen, of, group, k).where(F.col("rank") == k).collect():  # one row per (group, seed) at most
        of[row[group]][row["seed"]] = row["_order"]
    return _ranked(keys, of, group, k).select(group, "seed", "rank", "flagged_pk")


def _ranked(keys: DataFrame, of: dict[object, dict[int, str]], group: str, k: int) -> DataFrame:
    """The first ``k`` of the keys within the bound of each of their group's seeds: (group, seed, _order, flagged_pk, rank)."""
    asked = F.lit(None).cast("array<struct<seed:bigint,bound:string>>")
    for name, bounds in of.items():
        grid = F.array(*[F.struct(F.lit(s).cast("bigint").alias("seed"), F.lit(b).alias("bound")) for s, b in bounds.items()])
        asked = F.when(F.col(group).eqNullSafe(F.lit(name)), grid).otherwise(asked)
    met = keys.select(group, "flagged_pk", F.explode(asked).alias("_asked")).select(
        group, "_asked.seed", stable_order(F.col("_asked.seed"), F.col("flagged_pk")).alias("_order"), "flagged_pk", "_asked.bound")
    near = met.where(F.col("_order") <= F.col("bound")).drop("bound")
    window = Window.partitionBy(group, "seed").orderBy("_order", "flagged_pk")
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, group: str, seed: str, key: str) -> DataFrame:
    """``rows`` with ``number``, counting from 0 without gaps within the group in stable order.

    The order is a digest, so its leading digits cut a group into even blocks. Rows are ranked within
    blocks of about BLOCK_ROWS and moved up by the rows of the blocks before, so no task sorts a group.
    """
    ordered = rows.withColumn("_order", stable_order(F.col(seed), F.col(key)))
    most = ordered.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = min(MOST_DIGITS, max(1, math.ceil(math.log(max(most / BLOCK_ROWS, 1), 16))))
    dealt = ordered.withColumn("_block", F.substring("_order", 1, digits))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n")).select(
        group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(group, "_block").orderBy("_order", key)
    # At most 16 ** MOST_DIGITS rows a group: shuffled like the blocks, not sent through the driver.
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(starts, [group, "_block"])
    return placed.withColumn("number", F.col("_start") + F.col("_at") - 1).drop("_order", "_block", "_at", "_start")


def test_size(n: Column, share: float = TEST_SHARE) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("bigint")


def cut_points(rows: DataFrame, group: str, order: str, key: str, share: float = TEST_SHARE) -> DataFrame:
    """Per group the (order, key) up to which its rows make up ``share`` of it, at least one row.

    A distributed selection: rows are counted by the leading hex digits of their order, the range that holds the
    wanted rank is counted by further digits, and so on until ranges are small; the row is then found among the
    distinct (order, key) of one range. Every round is one aggregation of at most 16 ** RANGE_DIGITS rows a
    group, whose result is written; only the size of the largest range comes to the driver. Returns
    (group, cut_order, cut_key).
    """
    store = TableStore(rows.sparkSession)
    wanted = store.table("wanted", lambda: rows.groupBy(F.col(group).alias("_class")).agg(F.count("*").alias("_n")).select(
        "_class", F.lit("").alias("_range"), test_size(F.col("_n"), share).alias("_rank"), "_n"))
    digits = 0
    while (wanted.agg(F.max("_n")).first()[0] or 0) > SMALL_RANGE and digits < 30:
        digits += RANGE_DIGITS
        counted = _within(rows, wanted, group, order, key).groupBy(
            F.col(group).alias("_class"), F.substring(order, 1, digits).alias("_at")).agg(
            F.count("*").alias("_n"), F.min("_rank").alias("_rank"))
        wanted = store.table(f"wanted-{digits}", lambda c=counted: _holding(c, "_at").select(
            "_class", F.col("_at").alias("_range"), (F.col("_rank") - F.col("_before")).alias("_rank"), "_n"))
    last = _within(rows, wanted, group, order, key).groupBy(
        F.col(group).alias("_class"), F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("_at")).agg(
        F.count("*").alias("_n"), F.min("_rank").alias("_rank"))
    return store.table("cuts", lambda: _holding(last, "_at").select(
        F.col("_class").alias(group), F.col("_at.o").alias("cut_order"), F.col("_at.k").alias("cut_key")))


def _within(rows: DataFrame, wanted: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """The rows of each group's wanted range."""
    found = salted_lookup(rows, wanted.select("_class", "_range", "_rank"), group, "_class", F.col(key), "inner")
    return found.where(F.startswith(order, "_range"))


def _holding(counted: DataFrame, at: str) -> DataFrame:
    """Of counted ranges the one of each class that holds its rank, with the rows before it."""
    before = Window.partitionBy("_class").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return summed.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))


def split_by_order(rows: DataFrame, group: str, seed: str, key: str, share: float = TEST_SHARE) -> DataFrame:
    """``rows`` with ``split``: of every group the first ``share`` in stable order are its test rows.

    At least one row of a group is; equal keys of a group fall on one side, so that a key that repeats across
    the cut makes the test part larger. A null key has its own place in that order. No row is numbered and no group is sorted:
    rows are compared with their group's cut.
    """
    ordered = rows.withColumn("_order", F.coalesce(stable_order(F.col(seed), F.col(key)), F.lit("")))
    cuts = cut_points(ordered, group, "_order", key, share).withColumnRenamed(group, "_class")
    judged = salted_lookup(ordered, cuts, group, "_class", F.col(key))
    mine, cut = F.struct(F.col("_order").alias("o"), F.col(key).alias("k")), F.struct(F.col("cut_order").alias("o"), F.col("cut_key").alias("k"))
    return judged.withColumn("split", F.when(mine <= cut, "test").otherwise("train")).drop("_order", "cut_order", "cut_key")


def stratified_split(
    episodes: DataFrame, group: str, number: str, share: float = TEST_SHARE
) -> DataFrame:
    """The first episodes of every class go to the test split, at least one per class.

    ``number`` counts from 0 within the class. Class sizes are an aggregate with one row per
    class, looked up with salt; rows are not ranked again, so a large class needs no sort.
    """
    sizes = episodes.groupBy(F.col(group).alias("_class")).agg(F.count("*").alias("_size"))
    sized = salted_lookup(episodes, sizes, group, "_class", F.col(number))
    split = F.when(F.col(number) < test_size(F.col("_size")), "test").otherwise("train")
    return sized.withColumn("split", split).drop("_size")


def split_stats(episodes: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Episode counts by split and by each given dimension, in one pass over the rows."""
    cells = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    )
    return (
        episodes.select("split", F.explode(cells).alias("cell"))
        .groupBy("cell.dimension", "cell.value")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("split") == "test").alias("n_test"),
            F.round(F.avg((F.col("split") == "test").cast("int")), 4).alias("test_share"),
        )
    )
