"""The trie of conversation prefixes, with what storing shared prefixes once would save.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Prefixes are known by
128-bit digests, built up turn by turn, so no text is shuffled. A count-min sketch over all digests is filled
in two rows of counters; where the lesser of a digest's two counters is one, the prefix is proven to belong to
a single conversation, and its node is emitted where it stands: nothing below it is shared. Only prefixes that
may be shared, which are the shared ones and a few taken for such, are shuffled and grouped exactly.

Sums over subtrees need no walk: every node has one conversation, its smallest member, that stands for it. A
node's leaves are those of its members that stand for a childless node, and its savings those of the nodes for
which its members stand at its depth or below, which is a running sum along each conversation.

Very long conversations are split: turns are put in order by ranges, numbered within a range and moved on by the
counts of the ranges before (at most one conversation continues into a range, so there are as few offsets as
ranges); running digests and sums go block by block of ``BLOCK`` turns, and then over the blocks.

The sketch has ``SLOTS_PER_PREFIX`` slots a prefix and ``MOST_SLOTS`` at most, which is 32 MB of bits to
broadcast (only whether a slot counts more than one is kept). Beyond some ten million prefixes it fills up and
proves fewer of them single; more rows are then shuffled, and the result is the same.

Results of odd input: a null role or text counts as empty. Turns without a conv_id are in no conversation. Null
turn numbers come first; turns of one number are put in the order of a hash of role and text, and repeated rows
stay. A rebuilt conversation may have no turns: it is a member of the root alone. Without conversations there is
no root, and no rows. Further columns are not read. A text may be as long as a row can be; only its hash and its
number of words are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recon.llm.common import written
from recon.operators.joins import salted_lookup

#: Conversations are rebuilt on the turns of every GROUP-th one, at most HEAD - 1 of them.
GROUP, HEAD = 20, 4
#: Turns of one conversation that are summed in one go.
BLOCK = 1024
SLOTS_PER_PREFIX = 16
MOST_SLOTS = 1 << 27
_LEAST_SLOTS = 1 << 16
#: Slots packed by one task, and bytes of one chunk of ids that is hashed.
_PACK = 1 << 19
_CHUNK = 1 << 16

_EMPTY = hashlib.sha256().hexdigest()


def _hash(salt: int, *columns) -> Column:
    return F.xxhash64(F.lit(salt), *columns)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns in order: (conv_id, pos from 1, a, b, words), a and b being two hashes of role and text; written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", _hash(1, role, text).alias("a"), _hash(2, role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    # Equal rows get a number too, so that any conversation can be cut anywhere.
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    ranged = written(turns.repartitionByRange("conv_id", "turn", "a", "b", "row").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(before))
               .where("offset IS NOT NULL").select("conv_id", "part", "offset"))
    here = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "a", "b", "row")
    # Not more offsets than ranges: a range can continue one conversation only.
    return written(ranged.withColumn("local", F.row_number().over(here))
                   .join(F.broadcast(offsets), ["conv_id", "part"], "left")
                   .select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "a", "b", "words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared heads: turns (conv_id, pos, a, b, words), and (conv_id, total) of all of them.

    A conversation c takes the first h turns of c - c % GROUP, then its own after the first h, where h is
    the unsigned crc32 of its number as text, modulo HEAD.
    """
    turns = numbered_turns(conversations)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % GROUP)
    donors = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    plan = written(lengths.join(donors, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"), "n"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD)).withColumnRenamed("conv_id", "base")
    given = plan.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken")
    own = salted_lookup(turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).where("pos > h").drop("h"),
                        plan.select(F.col("conv_id").alias("of"), "h", "taken"), "conv_id", "of", F.col("pos"), how="inner")
    names = ["conv_id", "pos", "a", "b", "words"]
    rows = given.select(names).unionByName(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words"))
    totals = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    return written(rows), totals


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the same two tables."""
    turns = numbered_turns(conversations)
    return turns, turns.groupBy("conv_id").agg(F.max("pos").alias("total"))


def _running(rows: DataFrame, values: dict[str, str], combine, falling: bool = False) -> DataFrame:
    """Replace columns by running totals along each conversation, in rising or falling order of pos."""
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / BLOCK).cast("bigint"))
    step = (lambda c: F.col(c).desc()) if falling else F.col
    inside = Window.partitionBy("conv_id", "_block").orderBy(step("pos"))
    outside = Window.partitionBy("conv_id").orderBy(step("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = blocked.groupBy("conv_id", "_block").agg(*[combine(c).alias(f"_{c}") for c in values])
    passed = whole.select("conv_id", "_block", *[combine(f"_{c}").over(outside).alias(f"_{c}") for c in values]).where(
        " OR ".join(f"_{c} IS NOT NULL" for c in values))
    running = blocked.select(*[c for c in blocked.columns if c not in values],
                             *[combine(c).over(inside).alias(c) for c in values])
    joined = running.join(passed, ["conv_id", "_block"], "left")
    return joined.select(*[c for c in rows.columns if c not in values],
                         *[F.expr(f"coalesce({op.format(a=c, b=f'_{c}')}, {c})").alias(c) for c, op in values.items()])


def prefixes(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """Every prefix of every conversation but the empty one: digest (x, y), its parent's (px, py), whether it is
    the whole conversation; written."""
    own = turns.select("conv_id", "pos", "words", _hash(3, "pos", "a", "b").alias("x"), _hash(4, "pos", "a", "b").alias("y"))
    own = own.withColumn("ox", F.col("x")).withColumn("oy", F.col("y"))
    along = _running(own, {"x": "{a} ^ {b}", "y": "{a} ^ {b}"}, F.bit_xor)
    known = salted_lookup(along, totals.withColumnRenamed("conv_id", "of"), "conv_id", "of", F.col("pos"), how="inner")
    return written(known.select("conv_id", "pos", "words", "x", "y", F.col("x").bitwiseXOR(F.col("ox")).alias("px"),
                                F.col("y").bitwiseXOR(F.col("oy")).alias("py"), (F.col("pos") == F.col("total")).alias("whole")))


def _slots(x, y, width: int) -> list[np.ndarray]:
    """The two slots of digests, from independent bits."""
    x, y = (np.asarray(v).astype(np.int64).view(np.uint64) for v in (x, y))
    return [((v * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(20)).astype(np.int64) & (width - 1) for v in (x, y)]


class Sketch:
    """A count-min sketch of two rows, of which only the bits 'counts more than one' are kept."""

    def __init__(self, rows: DataFrame, most_slots: int = MOST_SLOTS):
        wanted = max(_LEAST_SLOTS, rows.count() * SLOTS_PER_PREFIX)
        self.width = width = min(most_slots, 1 << (wanted - 1).bit_length())

        def count(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for row, slot in enumerate(_slots(batch.column("x"), batch.column("y"), width)):
                    at, n = np.unique(slot, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), row, np.int32)), pa.array(at), pa.array(n.astype(np.int64))], names=["line", "slot", "n"])

        counted = (rows.select("x", "y").mapInArrow(count, "line int, slot bigint, n bigint")
                   .groupBy("line", "slot").agg(F.sum("n").alias("n")).where("n > 1"))

        def pack(key, table):
            bits = np.zeros(min(_PACK, width), bool)
            bits[table.column("slot").to_numpy() % _PACK] = True
            return pa.table({"line": [key[0].as_py()], "block": [key[1].as_py()], "bits": [np.packbits(bits).tobytes()]},
                            schema=pa.schema([("line", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())]))

        # A group has at most _PACK slots, and all blocks together are 2 * width bits.
        packed = (counted.withColumn("block", F.floor(F.col("slot") / _PACK).cast("bigint")).groupBy("line", "block")
                  .applyInArrow(pack, "line int, block bigint, bits binary").collect())
        self.bits = np.zeros((2, width // 8), np.uint8)
        for r in packed:
            at = r.block * _PACK // 8
            self.bits[r.line, at: at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)

    def may_be_shared(self, x, y) -> np.ndarray:
        """Whether the estimate is above one; false proves that a digest was counted once."""
        out = np.ones(len(x), bool)
        for row, slot in enumerate(_slots(x, y, self.width)):
            out &= (self.bits[row, slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)
        return out


def screened(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """Prefixes with ``shared`` and ``parent_shared``: whether theirs or their parent's estimate is above one."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def screen(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            mine = shared.value.may_be_shared(batch.column("x"), batch.column("y"))
            parent = shared.value.may_be_shared(batch.column("px"), batch.column("py"))
            parent |= batch.column("pos").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine), pa.array(parent)],
                                             names=[*batch.schema.names, "shared", "parent_shared"])

    return rows.mapInArrow(screen, StructType(list(rows.schema)).add("shared", "boolean").add("parent_shared", "boolean"))


def _id_digests(ends: DataFrame) -> DataFrame:
    """(pos, x, y, ends_sha256) of nodes at which conversations end, from (pos, x, y, conv_id).

    Ids are put in order by ranges and joined to chunks of bounded length there, the chunks of a node are then
    hashed one after the other: no list of ids is held, however many end at one node.
    """
    key = ["pos", "x", "y"]

    def join_ids(batches: Iterator[pa.RecordBatch]):
        node, first, held, size = None, None, [], 0

        def chunk():
            return pa.RecordBatch.from_pylist([dict(zip(key, node), first=first, ids=",".join(held))],
                                              schema=pa.schema([(c, pa.int64()) for c in (*key, "first")] + [("ids", pa.string())]))

        for batch in batches:
            for *at, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id"))):
                if node is not None and (at != node or size > _CHUNK):
                    yield chunk()
                    node, held, size = None, [], 0
                if node is None:
                    node, first = at, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if node is not None:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]):
        node, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(key, node), ends_sha256=state.hexdigest())],
                                              schema=pa.schema([(c, pa.int64()) for c in key] + [("ends_sha256", pa.string())]))

        for batch in batches:
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
        if node is not None:
            yield row()

    long_key = [F.col(c).cast("bigint").alias(c) for c in key]
    chunks = (ends.select(*long_key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(join_ids, "pos bigint, x bigint, y bigint, first bigint, ids string"))
    return (chunks.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(digest, "pos bigint, x bigint, y bigint, ends_sha256 string"))


_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: tuple[DataFrame, DataFrame], most_slots: int = MOST_SLOTS) -> DataFrame:
    """All nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Takes what ``plain`` or ``rebuilt`` returns."""
    turns, totals = conversations
    rows = prefixes(turns, totals)
    seen = written(screened(rows, Sketch(rows, most_slots)))
    key = ["pos", "x", "y"]
    maybe = seen.where("shared").select("conv_id", *key, "px", "py", "words", "whole")
    roots = totals.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("x"),
                          F.lit(0).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("px"),
                          F.lit(None).cast("bigint").alias("py"), F.lit(0).cast("bigint").alias("words"), (F.col("total") == 0).alias("whole"))
    maybe = maybe.select(roots.columns).unionByName(roots)
    groups = written(maybe.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("first"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.min("words").alias("words"), F.bool_and("whole").alias("childless")))

    # What the conversation that stands for a node brings to all nodes above it.
    stands = groups.select(F.col("first").alias("conv_id"), "pos", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                           F.col("childless").cast("bigint").alias("leaf"))
    tails = seen.where("whole AND NOT shared").select("conv_id", "pos", F.lit(0).cast("bigint").alias("saved"), F.lit(1).cast("bigint").alias("leaf"))
    zero = F.lit(0).cast("bigint")
    brought = (maybe.select("conv_id", *key).join(stands, ["conv_id", "pos"], "left")
               .withColumn("saved", F.coalesce("saved", zero)).withColumn("leaf", F.coalesce("leaf", zero))
               .unionByName(tails, allowMissingColumns=True))
    below = _running(brought, {"saved": "{a} + {b}", "leaf": "{a} + {b}"}, F.sum, falling=True)
    sums = below.where("x IS NOT NULL").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    # Nodes with a parent that may be shared: it names them their parent, they are its children.
    edge = seen.where("NOT shared AND parent_shared").select("conv_id", *key, "px", "py", "whole")
    links = groups.where("pos > 0").select(F.col("pos") - 1, "px", "py").unionAll(edge.select(F.col("pos") - 1, "px", "py")).toDF(*key)
    children = links.groupBy(*key).agg(F.count("*").alias("n_children"))
    ends = _id_digests(maybe.where("whole").select(*key, "conv_id"))
    nodes = written(groups.join(sums, key).join(children, key, "left").join(ends, key, "left").select(
        F.col("first").alias("conv_id"), *key, "px", "py", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))

    def alone(frame: DataFrame, *more) -> DataFrame:
        """Nodes of one conversation: a chain to its end."""
        return frame.select("conv_id", "pos", *more, F.lit(1).cast("bigint").alias("n_convs"),
                            F.when(F.col("whole"), 0).otherwise(1).cast("bigint").alias("n_children"),
                            F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"),
                            F.when(F.col("whole"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY).alias("ends_sha256"))

    asking = nodes.select("conv_id", "pos", "px", "py", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").unionByName(
        alone(edge, "px", "py")).withColumn("above", F.struct(F.col("pos") - 1, "px", "py").cast("struct<p:bigint,x:bigint,y:bigint>"))
    names = groups.select(F.struct("pos", "x", "y").cast("struct<p:bigint,x:bigint,y:bigint>").alias("of"), F.col("first").alias("parent_conv_id"))
    # A node taken for shared may hang below one proven single: then both have the same only member.
    below_root = salted_lookup(asking.where("pos > 1"), names, "above", "of", F.col("conv_id")).drop("above", "px", "py").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    root_id = groups.where("pos = 0").select(F.col("first").alias("parent_conv_id"))
    at_root = asking.where("pos = 1").drop("above", "px", "py").crossJoin(F.broadcast(root_id))
    root = asking.where("pos = 0").drop("above", "px", "py").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    chains = alone(seen.where("NOT shared AND NOT parent_shared")).withColumn("parent_conv_id", F.col("conv_id"))
    every = below_root.unionByName(at_root).unionByName(root).unionByName(chains)
    return every.withColumnRenamed("pos", "depth").select(*[F.col(c).cast("string" if c == "ends_sha256" else "bigint").alias(c) for c in _COLUMNS])
