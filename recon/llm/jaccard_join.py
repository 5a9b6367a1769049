"""N-gram Jaccard join: exact links between sets of word shingles, by set-relation skipping.

Relations between sets save most of the work, at three steps.

* Equal sets have equal answers: one row stands for them all.
* Index lists. A set is indexed under the first shingles of an order that puts frequent ones last,
  enough that a linked set must share NEEDED of them. A list is cut into blocks of size; a block whose
  sizes leave too little room for the overlap is skipped whole. Positions and sketches of two entries are
  compared within the join of a list's neighbouring blocks, which passes on only pairs that may be linked.
* Answers of a similar set. Each set is compared with the LAGS before it in its lists, each list in an order
  of its own, and the nearest one is measured; linked sets form groups, for which the same is done again, TURNS
  in all. Sets much closer than a link asks for form clusters. From then on a cluster is one entry of a list, and its first
  set, the pivot, answers for it: distances of sets are a metric, so two clusters whose pivots lie farther apart
  than the limit and both radii together have no link, and two whose pivots are linked need no other. Only
  what lies between is looked at set by set, and two clusters of one group are not looked at again.
* Sketches. A set's sketch has, for each of SKETCH_BITS places, the parity of the shingles hashed to it. Two
  sketches differ in at most as many places as their sets have shingles apart, so they bound the distance
  from below and drop no link. Sets of more than SKETCHED shingles would fill the places; of up to four times as many
  a quarter of the shingles is taken, by hash, and so on. Sketches of different shares bound nothing. Where any true links
  will do, as among neighbours, pairs whose sketches differ by clearly more places than a link's would are not measured either.

Frequencies come from counters of a fixed number that cover all texts; they choose the order alone, and
any order gives the same links. Sets are known by a 64-bit digest, shingles by a 64-bit hash.

Defined results: a row whose text is null or has no words has an empty set, links to nothing and is its own
component; rows without an id are reported with a null component and take no part; rows that share an
id are each linked by their own text. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.llm.common import fits, slices, texts, written
from recon.llm.components import components
from recon.llm.words import Words, mix, windows

NEEDED = 3
COUNTER_BITS = 18
#: Sets looked up by a broadcast of their ids; more are looked up by a join.
BROADCAST_IDS = 1_000_000
#: Sets a task remembers, so as to index copies once; others are told apart after the shuffle.
SEEN_SETS = 500_000
SKETCH_BITS = 512
#: Shingles of a set whose sketch takes all of them.
SKETCHED = 1_400
QUARTERINGS = 5
#: Standard deviations of a full sketch's differing places, by which neighbours may differ more than a link makes expect.
SPREAD = 3
#: Entries of a list that are all compared with each other; longer lists are cut into blocks of size first.
SHORT_LIST = 32
#: Bytes of text a step works on: its shingles take many times as much, in each of an executor's workers.
STEP_BYTES = 1 << 20
#: Entries before its own that a set is compared with in each of its lists.
LAGS = 4
TURNS = 2
#: Sets of a cluster are linked at this share of the distance a link allows.
TIGHT = 1 / 3


def shingle_sets(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle) of every distinct shingle, ordered by owner and shingle.

    A text of fewer words than ``width`` has its whole word sequence as the one shingle.
    """
    words = Words(array, fold=True)
    h, bounds = words.hashes(), words.bounds
    owners, marks = [], []
    whole, starts = windows(h, bounds, width)
    owners.append(np.searchsorted(bounds, starts, side="right") - 1)
    marks.append(whole)
    count = np.diff(bounds)
    for n in range(1, width):
        who = np.flatnonzero(count == n)
        if len(who):
            acc = np.full(len(who), n, np.uint64)
            for k in range(n):
                acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[bounds[who] + k])
            owners.append(who)
            marks.append(acc)
    owner, mark = np.concatenate(owners), np.concatenate(marks)
    order = np.lexsort((mark, owner))
    owner, mark = owner[order], mark[order]
    first = np.ones(len(mark), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
    return owner[first], mark[first]


def digests(owner: np.ndarray, mark: np.ndarray, rows: int) -> np.ndarray:
    """One number a set, whatever the order of its shingles; sums are taken modulo 2**64."""
    cuts = np.searchsorted(owner, np.arange(rows + 1))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mark * np.uint64(salt)), dtype=np.uint64)])
        out.append(sums[cuts[1:]] - sums[cuts[:-1]])
    return mix(mix(out[0]) * np.uint64(3) + out[1]).view(np.int64)


def _fourths(size: np.ndarray | Column) -> np.ndarray | Column:
    """How often the shingles of sets of these sizes are quartered for their sketches; by whole numbers, so that both ways agree."""
    steps = (size > SKETCHED * 4**k for k in range(QUARTERINGS))
    if isinstance(size, np.ndarray):
        return sum(x.astype(int) for x in steps)
    return functools.reduce(lambda a, b: a + b, [x.cast("int") for x in steps])


def sketches(owner: np.ndarray, mark: np.ndarray, rows: int) -> pa.Array:
    """SKETCH_BITS parities a set, of a share of its shingles that falls with its size, as a list of 64-bit numbers."""
    spread = mix(mark * np.uint64(0x9E6C63D0876A9A47))
    share = (np.uint64(1) << (2 * _fourths(np.bincount(owner, minlength=rows))).astype(np.uint64)) - np.uint64(1)
    taken = (spread >> np.uint64(32)) & share[owner] == 0
    place = owner[taken] * SKETCH_BITS + (spread[taken] % np.uint64(SKETCH_BITS)).astype(np.int64)
    place, times = np.unique(place, return_counts=True)
    odd = np.zeros(rows * SKETCH_BITS, bool)
    odd[place[times % 2 == 1]] = True
    words = SKETCH_BITS // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * words), pa.array(np.packbits(odd).view(np.int64)))


def _apart(a: str, b: str) -> Column:
    """Places in which the sketches ``a_sketch`` and ``b_sketch`` differ."""
    return sum((F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _least_distance(a: str, b: str) -> Column:
    """A lower bound of the distance of the sets whose size and sketch are ``a_size``, ``a_sketch``, ``b_size``, ``b_sketch``."""
    apart = F.when(_fourths(F.col(f"{a}_size")) == _fourths(F.col(f"{b}_size")), _apart(a, b)).otherwise(0)
    return 2 * apart / (F.col(f"{a}_size") + F.col(f"{b}_size") + apart)


def _likely(a: str, b: str, percent: int) -> Column:
    """Whether sketches of the same share differ in no more places than those of linked sets do, chance included; proves nothing."""
    level = _fourths(F.col(f"{a}_size"))
    most = (F.col(f"{a}_size") + F.col(f"{b}_size")) * F.lit((100 - percent) / (100 + percent)) + 1e-6  # apart, of linked sets
    places = SKETCH_BITS / 2 * (1 - F.exp(-2 / SKETCH_BITS * most / F.pow(F.lit(4.0), level))) + SPREAD * math.sqrt(SKETCH_BITS) / 2
    return (level == _fourths(F.col(f"{b}_size"))) & (_apart(a, b) <= F.least(most, places))


def _surveyed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, sketch) of every row, and (counter, n) of the frequencies, told apart by ``kind``."""

    def survey(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.int64)
        for part in slices(batches, STEP_BYTES):
            owner, mark = shingle_sets(part.column("text"), width)
            counters += np.bincount((mark >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counters))
            n = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(part.num_rows, np.int32)), part.column("doc_id"), pa.array(n),
                 pa.array(digests(owner, mark, part.num_rows)), sketches(owner, mark, part.num_rows)], names=names)
        at = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(counters[at]), pa.array(np.zeros(len(at), np.int64)),
             pa.nulls(len(at), pa.list_(pa.int64()))], names=names)

    names = ["kind", "doc_id", "n", "key", "sketch"]
    return texts(docs).mapInArrow(survey, "kind int, doc_id bigint, n bigint, key bigint, sketch array<bigint>")


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100): shared by a set of n and any set it is linked to."""
    return -(-percent * n // 100)


def _index(docs: DataFrame, frequency: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, key, n, at): the first shingles of each set in the order, with their position."""
    sent = docs.sparkSession.sparkContext.broadcast(frequency)

    def entries(batches):
        frequency, seen = sent.value, set()
        for part in slices(batches, STEP_BYTES):
            owner, mark = shingle_sets(part.column("text"), width)
            key = digests(owner, mark, part.num_rows)
            n = np.bincount(owner, minlength=part.num_rows)
            often = frequency[(mark >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
            order = np.lexsort((mark, often, owner))
            owner, mark = owner[order], mark[order]
            at = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
            own, least = n[owner], _least_overlap(n[owner], percent)
            fresh = np.array([k not in seen and not seen.add(k) for k in key.tolist()], bool)  # copies of this task
            if len(seen) > SEEN_SETS:
                seen.clear()
            keep = (at < own - least + np.minimum(NEEDED, least)) & fresh[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark[keep].view(np.int64)), pa.array(key[owner[keep]]), pa.array(own[keep].astype(np.int32)),
                 pa.array(at[keep].astype(np.int32))], names=["token", "key", "n", "at"])

    named = texts(docs).where("doc_id IS NOT NULL")
    # One shuffle, by token, serves both the copies of other tasks and the lengths of the lists.
    found = named.mapInArrow(entries, "token bigint, key bigint, n int, at int").repartition("token").distinct()
    return found.withColumn("length", F.count("*").over(Window.partitionBy("token"))).where("length > 1").drop("length")


def _room(n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)


def _needed(a0: Column, a1: Column, b0: Column, b1: Column, percent: int) -> Column:
    """How many of their first shingles sets of sizes a0 to a1 and b0 to b1 share at least, if they are linked.

    A set of n shows its first n - ceil(percent n / 100) + NEEDED shingles. For an overlap of o, two sets that
    show n - o + k each share k of these; the closer their sizes, the larger is o.
    """
    overlap = F.ceil((a0 + b0) * F.lit(percent / (100 + percent)) - 1e-6)
    hidden = F.ceil(F.greatest(a1, b1) * percent / 100)
    least = F.least(F.lit(NEEDED), F.ceil(F.least(a0, b0) * percent / 100))
    return F.greatest(least, overlap - hidden + least)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, marks) of the wanted sets; ``wanted`` is (doc_id, key) with one row a key."""
    rows = texts(docs)
    ids = written(wanted)
    few = fits(ids, BROADCAST_IDS)
    own = rows.join(F.broadcast(ids) if few else ids, "doc_id").select("text", "key")

    def made(batches):
        for part in slices(batches, STEP_BYTES):
            owner, mark = shingle_sets(part.column("text"), width)
            right = digests(owner, mark, part.num_rows) == part.column("key").to_numpy()
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(
                pa.array(cuts), pa.array(mark.view(np.int64)))], names=["key", "marks"])
            yield out.filter(pa.array(right))

    return written(own.mapInArrow(made, "key bigint, marks array<bigint>"))


def _measured(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, either) of pairs of keys: sizes of the intersection and of the union of the two sets."""
    pairs = written(pairs.select("a", "b").distinct())
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = _sets(docs, classes.join(keys, "key").select("doc_id", "key"), width)
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("marks").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("marks").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return (both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
            .select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("either")).distinct())


def link(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, labels): rows is (doc_id, n, key), key naming the set; links is (a, b) between keys,
    enough of them to connect what the whole relation connects; labels is (node, label) of keys linked."""
    survey = written(_surveyed(docs, width))
    rows = survey.where("kind = 0").select("doc_id", "n", "key")
    frequency = np.zeros(1 << COUNTER_BITS, np.int64)  # a fixed number of counters
    for r in survey.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():
        frequency[r.doc_id] = r.n
    classes = written(survey.where("kind = 0 AND doc_id IS NOT NULL AND n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("size"), F.first("sketch").alias("sketch")))  # alike for one key
    index = written(_index(docs, frequency, width, percent))
    is_link = F.col("shared") * 100 >= F.col("either") * percent

    # Neighbours in lists: any true links will do here, so the nearest set outside its group is enough for a group.
    limit = 1 - percent / 100 + 1e-9
    listed = written(index.join(classes.select("key", "sketch"), "key"))
    near = groups = None
    for turn in range(TURNS):
        here = listed.withColumn("band", F.col("key")) if groups is None else listed.join(
            groups.withColumnRenamed("node", "key"), "key", "left").withColumn("band", F.coalesce("band", "key"))
        order = Window.partitionBy("token").orderBy(F.xxhash64("key", "token", F.lit(turn)), "key")
        before = here.select(F.col("key").alias("b"), F.col("band").alias("b_band"), F.col("n").alias("b_size"), F.col("sketch").alias("b_sketch"), *[
            F.lag(c, k).over(order).alias(f"a{k}_{name}") for k in range(1, LAGS + 1)
            for c, name in (("key", "key"), ("band", "band"), ("n", "size"), ("sketch", "sketch"))])
        ways = [F.when((F.col(f"a{k}_band") != F.col("b_band")) & _room(F.col(f"a{k}_size"), F.col("b_size"), percent)
                       & _likely(f"a{k}", "b", percent),
                       F.struct((_apart(f"a{k}", "b") / (F.col(f"a{k}_size") + F.col("b_size"))).alias("apart"), F.col(f"a{k}_key").alias("a"), "b"))
                for k in range(1, LAGS + 1)]
        beside = (before.select("b_band", F.array_min(F.array(*ways)).alias("way")).where("way IS NOT NULL")
                  .groupBy("b_band").agg(F.min("way").alias("way")).select("way.a", "way.b"))
        links = _measured(docs, beside, classes, width).where(is_link)
        near = written(links if near is None else near.unionByName(links))
        groups = written(components(near.select("a", "b")).withColumnRenamed("label", "band"))
    clusters = written(components(near.where((F.col("either") - F.col("shared")) <= F.col("either") * limit * TIGHT).select("a", "b")))

    # Pivots and radii: how far each set is from the first of its cluster.
    spokes = clusters.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
    off = written(_measured(docs, spokes, classes, width)
                  .select(F.col("a").alias("cluster"), F.col("b").alias("key"), (1 - F.col("shared") / F.col("either")).alias("off")))
    radius = written(off.groupBy("cluster").agg(F.max("off").alias("radius")))

    # Lists of clusters: pairs that share as many first shingles as a link needs, and whose pivots may be near enough.
    placed = written(groups.join(clusters, "node", "left").select(
        F.col("node").alias("key"), F.coalesce("label", "node").alias("cluster"), "band"))
    labelled = (index.join(placed, "key", "left").select(
        "token", "n", "at", F.coalesce("cluster", "key").alias("cluster"), F.coalesce("band", "key").alias("band")).repartition("token"))
    block = F.floor(F.log("n") / -math.log(percent / 100) + 1e-9).cast("int")
    list_ = Window.partitionBy("token")
    entry = (labelled.groupBy("token", "cluster", "band", block.alias("block"))
             .agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("at").alias("p0"), F.max("at").alias("p1"))
             .withColumn("first", F.min("band").over(list_)).withColumn("last", F.max("band").over(list_))
             .where("first <> last").drop("first", "last")
             .withColumn("entries", F.count("*").over(list_)))
    pivot = written(classes.select(F.col("key").alias("cluster"), "size", "sketch").join(radius, "cluster", "left")
                    .select("cluster", "size", "sketch", F.coalesce("radius", F.lit(0.0)).alias("radius")))
    entry = written(entry.join(pivot, "cluster"))
    facts = ("band", "n0", "n1", "p0", "p1", "size", "sketch", "radius")
    # Short lists are joined with themselves whole, by one shuffle; of long ones, neighbouring blocks.
    few, many = entry.where(F.col("entries") <= SHORT_LIST), entry.where(F.col("entries") > SHORT_LIST)

    def side(name: str) -> list[Column]:
        return [F.col("token"), F.col("cluster").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in facts]]

    around = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    beside = (few.select(*side("a"), F.col("block").alias("a_block")).join(few.select(*side("b"), F.col("block").alias("b_block")), "token")
              .where(F.abs(F.col("a_block") - F.col("b_block")) <= 1).drop("a_block", "b_block")
              .unionByName(many.select(*side("a"), "block").join(many.select(*side("b"), around), ["token", "block"]).drop("block")))
    least = F.ceil((F.col("a_n0") + F.col("b_n0")) * F.lit(percent / (100 + percent)) - 1e-6)
    # Shared before and after this shingle, at most.
    most = F.least("a_p1", "b_p1") + 1 + F.least(F.col("a_n1") - F.col("a_p0"), F.col("b_n1") - F.col("b_p0")) - 1
    sizes = (F.col("a_n1") * 100 >= F.col("b_n0") * percent) & (F.col("b_n1") * 100 >= F.col("a_n0") * percent)
    near_enough = _least_distance("a", "b") <= limit + F.col("a_radius") + F.col("b_radius")
    shared = (beside.where((F.col("a") < F.col("b")) & (F.col("a_band") != F.col("b_band")) & sizes & (most >= least) & near_enough)
              .groupBy("a", "b", "token").agg(*[F.min(c).alias(c) for c in ("a_n0", "b_n0")], *[F.max(c).alias(c) for c in ("a_n1", "b_n1")]))
    across = (shared.groupBy("a", "b").agg(F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("a_n0", "b_n0")],
                                           *[F.max(c).alias(c) for c in ("a_n1", "b_n1")])
              .where(F.col("times") >= _needed(F.col("a_n0"), F.col("a_n1"), F.col("b_n0"), F.col("b_n1"), percent)))
    pivots = written(_measured(docs, across, classes, width))
    found = pivots.where(is_link).select("a", "b")

    # Between: farther than a link, nearer than both radii allow.
    far = 1 - F.col("shared") / F.col("either")
    reach = (pivots.where(~is_link).select("a", "b", far.alias("far"))
             .join(radius.select(F.col("cluster").alias("a"), F.col("radius").alias("ra")), "a", "left")
             .join(radius.select(F.col("cluster").alias("b"), F.col("radius").alias("rb")), "b", "left")
             .where(F.col("far") <= limit + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))))
    open_ = written(reach.where("ra IS NOT NULL OR rb IS NOT NULL").select("a", "b", "far"))
    joined = written(found.unionByName(near.select("a", "b")))
    if open_.limit(1).count():
        # Pairs of clusters that other links have joined meanwhile are settled.
        now = components(joined)
        own = open_.join(now.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(
            now.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").where(
            "la IS NULL OR lb IS NULL OR la <> lb").select("a", "b", "far")
        # Of two members only those can be linked that are far enough off their pivots, towards each other, and whose
        # sketches leave it open: first each member of a against the pivot of b, then against the members of b.
        inside = written(
            classes.join(clusters.withColumnRenamed("node", "key"), "key", "left").join(off.select("key", "off"), "key", "left")
            .select(F.coalesce("label", "key").alias("cluster"), "key", F.coalesce("off", F.lit(0.0)).alias("off"), "size", "sketch"))
        x = inside.select(F.col("cluster").alias("a"), *[F.col(c).alias(f"x_{c}") for c in ("key", "off", "size", "sketch")])
        y = inside.select(F.col("cluster").alias("b"), *[F.col(c).alias(f"y_{c}") for c in ("key", "off", "size", "sketch")])
        hub = pivot.select(F.col("cluster").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("size", "sketch", "radius")])
        reaching = (own.join(hub, "b").join(x, "a")
                    .where((F.col("x_off") + F.col("b_radius") >= F.col("far") - limit)
                           & (_least_distance("x", "b") <= limit + F.col("b_radius")))
                    .drop("b_size", "b_sketch", "b_radius"))
        members = (reaching.join(y, "b")
                   .where((F.col("x_off") + F.col("y_off") >= F.col("far") - limit) & (_least_distance("x", "y") <= limit))
                   .select(F.col("x_key").alias("a"), F.col("y_key").alias("b")).distinct())
        joined = written(joined.unionByName(_measured(docs, members, classes, width).where(is_link).select("a", "b")))
    return rows, joined, components(joined)


def near_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, _, labels = link(docs, width, percent)
    placed = written(rows.join(labels.withColumnRenamed("node", "key"), "key", "left")
                     .select("doc_id", "n", F.coalesce("label", "key").alias("label")))
    ids = placed.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = placed.where("n > 0").join(written(ids), "label").select("doc_id", "n", F.when(
        F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = placed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that have the least id of their component; rows without an id stay.

    Of rows that share that id, all stay.
    """
    first = near_groups(docs, width, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
