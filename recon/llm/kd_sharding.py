"""Sharding: a K-d tree over metadata, split at weighted medians until leaves reach the target bytes.

Equal texts form a group and take one place in the space of metadata, that of the group's first row: its
length, language and source (the latter two by hash). A node is split along its widest dimension, where
the bytes on both sides stand as the leaves on both sides; rows alike in that dimension are told apart
by a hash of the group. The median is found by counting bytes in ranges, in one job for all nodes of a level,
and counting again within the range that holds it. A group is kept together unless it is larger than
PART of a shard; larger ones are dealt into parts by row, as no shard could hold them evenly.

Defined results: a null or empty text has size 8, the bytes a row takes besides its text; null metadata
count as empty, a null doc_id comes first; repeated rows get places of their own. Fewer rows than shards
leave shards empty. Other columns are not read, and missing lang or source columns count as null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.llm.common import written

SHARDS = 24
ROW_BYTES = 8
#: A group of equal texts above this share of a shard is dealt into parts.
PART = 1 / 64
BINS = 512
#: Bytes on either side may miss their share by this much of a shard.
TOLERANCE = 1 / 2_000
SLOT_ROWS = 20_000
MOST_BLOCKS = 4_096
_DIMENSIONS = ("x0", "x1", "x2")
_ROUNDS = 12


@dataclass
class Node:
    """Leaves ``first`` to ``first + leaves - 1``; once split, rows below (value, tie) go left."""

    first: int
    leaves: int
    axis: str = ""
    value: float = math.inf
    tie: float = math.inf
    children: list[Node] = field(default_factory=list)


def _unit(x: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return x.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def weighed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group, place, row): all that is known of a row, without its text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    column = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
              for c in ("lang", "source")}
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"),
        column["lang"].alias("lang"), column["source"].alias("source"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"))


def grouped(rows: DataFrame, shard_bytes: float) -> DataFrame:
    """(group, x0, x1, x2, bytes, parts): where each group of equal texts lies, and its bytes."""
    first = F.min(F.struct("doc_id", "lang", "source", "size"))
    groups = rows.groupBy("group").agg(first.alias("f"), F.sum("size").cast("double").alias("bytes"),
                                       F.count("*").alias("n"))
    most = max(shard_bytes * PART, 1.0)
    return groups.select(
        "group", "bytes", F.log1p(F.col("f.size").cast("double")).alias("x0"), _unit(F.xxhash64("f.lang")).alias("x1"),
        _unit(F.xxhash64("f.source")).alias("x2"),
        F.least(F.ceil(F.col("bytes") / most), F.col("n")).cast("int").alias("parts"))


def _tie(part: Column) -> Column:
    return _unit(F.xxhash64("group", part))


def _left(node: Node) -> Column:
    x = F.col(node.axis)
    return (x < node.value) | ((x == node.value) & (F.col("tie") < node.tie))


def _walk(node: Node, leaf) -> Column:
    """An expression that follows the tree; ``leaf`` gives the value at a node without children."""
    if not node.children:
        return F.lit(leaf(node))
    return F.when(_left(node), _walk(node.children[0], leaf)).otherwise(_walk(node.children[1], leaf))


def _median(at: DataFrame, nodes: list[Node], ranges: dict[int, tuple], total: dict[int, float],
            tolerance: float) -> None:
    """Set (value, tie) of each node; ``at`` has the items with the node they are in."""
    by = {n.first: n for n in nodes if n.first in total}
    # Per node: the range that holds the median, the bytes below it, and the value once ties are counted.
    state = {k: [*ranges[k], 0.0, None] for k in by}
    for _ in range(_ROUNDS):
        if not state:
            return
        x, low, width, inside = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(False)
        for k, (lo, hi, _, value) in state.items():
            own = F.col("node") == k
            axis = F.col(by[k].axis) if value is None else F.col("tie")
            x, low = F.when(own, axis).otherwise(x), F.when(own, F.lit(lo)).otherwise(low)
            width = F.when(own, F.lit((hi - lo) / BINS or 1.0)).otherwise(width)
            inside |= own & axis.between(lo, hi) & (F.lit(value is None) | (F.col(by[k].axis) == F.lit(value)))
        number = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).cast("int")
        counts: dict[int, list] = {}
        for r in at.where(inside).withColumn("v", x).groupBy("node", number.alias("bin")).agg(
                F.sum("bytes").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault(r.node, []).append((r.bin, r.b, r.lo, r.hi))
        for k in list(state):
            _, _, below, value = state[k]
            node = by[k]
            goal = total[k] * (node.leaves // 2) / node.leaves
            bins = sorted(counts[k])
            for i, (_, b, first, last) in enumerate(bins):
                if below + b >= goal or i == len(bins) - 1:
                    break
                below += b
            after = bins[i + 1][2] if i + 1 < len(bins) else math.nextafter(last, math.inf)
            # The better of a cut below this bin and one above it; all of a bin of one value is on one side.
            missed, cut = min((abs(below - goal), first), (abs(below + b - goal), after))
            node.value, node.tie = (cut, -math.inf) if value is None else (value, cut)
            if missed <= tolerance or (value is not None and first == last):
                del state[k]
            elif first == last:
                state[k] = [0.0, 1.0, below, first]
            else:
                state[k] = [first, last, below, value]


def tree(items: DataFrame, shards: int, total: float) -> Node:
    """Split until each leaf stands for one shard; items are (group, x0, x1, x2, bytes, tie)."""
    root = Node(0, shards)
    level = [root]
    extent: dict[str, float] = {}
    while level := [n for n in level if n.leaves > 1]:
        at = items.withColumn("node", _walk(root, lambda n: n.first)).where(F.col("node").isin([n.first for n in level]))
        stats = {r.node: r for r in at.groupBy("node").agg(F.sum("bytes").alias("total"), *[
            f(x).alias(f"{f.__name__}_{x}") for x in _DIMENSIONS for f in (F.min, F.max)]).collect()}
        ends = {k: {x: (r[f"min_{x}"], r[f"max_{x}"]) for x in _DIMENSIONS} for k, r in stats.items()}
        for k, e in ends.items():
            extent = extent or {x: hi - lo or 1.0 for x, (lo, hi) in e.items()}
        for n in level:
            own = ends.get(n.first, {x: (0.0, 0.0) for x in _DIMENSIONS})
            n.axis = max(_DIMENSIONS, key=lambda x: (own[x][1] - own[x][0]) / extent.get(x, 1.0))
        _median(at, level, {n.first: ends[n.first][n.axis] for n in level if n.first in ends},
                {k: r.total for k, r in stats.items()}, total / shards * TOLERANCE)
        for n in level:
            half = n.leaves // 2
            n.children = [Node(n.first, half), Node(n.first + half, n.leaves - half)]
        level = [c for n in level for c in n.children]
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law ``bytes``, sizes of shards near equal."""
    rows = written(weighed(docs))
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    groups = written(grouped(rows, (total.b or 0) / shards))
    part = F.pmod("row", F.col("parts")).cast("int")
    # At most shards / PART groups are in parts, so their table may be broadcast.
    large = groups.where(F.col("parts") > 1).drop("bytes")
    dealt_out = (rows.join(F.broadcast(large), "group").groupBy("group", *_DIMENSIONS, part.alias("part"))
                 .agg(F.sum("size").cast("double").alias("bytes")))
    whole = groups.where(F.col("parts") == 1).withColumn("part", F.lit(0))
    items = written(whole.unionByName(dealt_out, allowMissingColumns=True)
                    .select(*_DIMENSIONS, "bytes", _tie(F.col("part")).alias("tie")))
    root = tree(items, shards, float(total.b or 0))
    placed = written(rows.join(groups.drop("bytes"), "group").withColumn("tie", _tie(part))
                     .select("doc_id", "size", "text_crc32", "row", _walk(root, lambda n: n.first).alias("shard")))
    # Slots: numbered within blocks of a shard, from where the blocks before end.
    blocks = min(MOST_BLOCKS, max(1, math.ceil(total.n / shards / SLOT_ROWS)))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
              .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "row")
    return (dealt.withColumn("at", F.row_number().over(order))
            .join(F.broadcast(starts), ["shard", "block"])  # at most shards * MOST_BLOCKS rows
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("at") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
