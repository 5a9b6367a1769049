"""Substring dedup: repeated windows of words, found by level-wise doubling.

A window of the length sought is removed where its words also start earlier: in a document of a smaller
id, or earlier in its own. Most windows occur once, so few of them are ever compared at full length. At
each length, from a short one doubled up to the length sought, every window still in question is
represented by the one of its sub-windows of that length with the least hash; equal windows have equal
representatives. Representatives are counted over the corpus, and only windows whose representative is
repeated are looked at again at twice the length. It ends at the length sought, or before, once none survives.

What survives a level is passed on as a Bloom filter whose size follows the number of repeated
hashes up to a bound of FILTER_BITS; a window it lets through by mistake is found single at the full length.
There, windows are told apart by two independent 64-bit hashes, and the first place of each is found by
an aggregation, combined before it is shuffled. Documents whose words all equal those of an earlier
document are settled at once and take no part in this.

Windows are judged on the input, not on what is left of it.

Defined results: a null text has no words. Null ids count as one id before all others; rows that share
an id are one document in order, so neither is earlier at the same start, and where their texts differ
one of them is taken as first. Documents shorter than a window keep all words. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import fits, slices, texts, written
from recon.llm.words import Words, mix, windows

WINDOW = 20
SHORTEST = 5
#: Bits for each repeated hash, and the most a filter has (128 MB).
BITS_PER_HASH = 32
FILTER_BITS = 1 << 30
_BLOCK_BITS = 12
#: Ids of copies that are told to every task; with more, the rest is written once instead.
BROADCAST_IDS = 2_000_000
_LEAST_ID = -(2**63)


def lengths(window: int, shortest: int) -> list[int]:
    """Doubled lengths up to the window: 20 from 5 gives 5, 10, 20."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


class Filter:
    """A Bloom filter in blocks; no hash that was put in is ever denied."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # (blocks, bytes of a block)

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        """Four bit positions of each hash in its block; the size of a block is a power of two."""
        again = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
        return [((again >> np.uint64(13 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(4)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block = (hashes >> np.uint64(64 - _BLOCK_BITS)).astype(np.int64)
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.bits.shape[1] * 8):
            out &= (self.bits[block, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out


def filter_of(hashes: DataFrame) -> Filter | None:
    """A filter of a column ``hash``; None if there is none. Each block is made by one group of rows."""
    count = hashes.count()
    if not count:
        return None
    size = 8
    while size * 8 << _BLOCK_BITS < min(count * BITS_PER_HASH, FILTER_BITS):
        size *= 2

    def block(key, rows):
        bits = np.zeros(size, np.uint8)
        for place in Filter.places(rows.column("hash").to_numpy().view(np.uint64), size * 8):
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()])})

    made = (hashes.withColumn("block", F.shiftrightunsigned("hash", 64 - _BLOCK_BITS)).groupBy("block")
            .applyInArrow(block, "block bigint, bits binary"))
    out = np.zeros((1 << _BLOCK_BITS, size), np.uint8)
    for r in made.collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


def representatives(h: np.ndarray, bounds: np.ndarray, starts: np.ndarray, window: int, length: int):
    """For windows at ``starts``: hash of the least sub-window of a length, and the word that one starts at."""
    full = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    marks, at = windows(h, bounds, length)
    full[at] = marks
    best, place = full[starts], starts.copy()
    for k in range(1, window - length + 1):
        other = full[starts + k]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + k
    return best, place


def surviving(words: Words, window: int, below: list[tuple[int, Filter]]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, starts of the windows whose representatives pass the filters of all shorter lengths)."""
    h = words.hashes()
    sizes = np.diff(words.bounds)
    starts = np.concatenate([np.arange(a, a + n - window + 1) for a, n in zip(words.bounds[:-1], sizes) if n >= window]
                            or [np.empty(0, np.int64)])
    for length, passed in below:
        if not len(starts):
            break
        starts = starts[passed.has(representatives(h, words.bounds, starts, window, length)[0])]
    return h, starts


def _counted(docs: DataFrame, window: int, length: int, below: list[tuple[int, Filter]]) -> DataFrame:
    """Hashes of representatives of a length that occur more than once."""
    sent = docs.sparkSession.sparkContext.broadcast(below)

    def counts(batches):
        for part in slices(batches):
            words = Words(part.column("text"))
            h, starts = surviving(words, window, sent.value)
            if len(starts):
                best, place = representatives(h, words.bounds, starts, window, length)
                first = np.ones(len(place), bool)  # neighbours share a place, and places never go back
                first[1:] = place[1:] != place[:-1]
                own, n = np.unique(best[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["hash", "n"])

    found = docs.select("text").mapInArrow(counts, "hash bigint, n bigint")
    return found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")


def _wide(words: Words, starts: np.ndarray, window: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows at ``starts``."""
    out = []
    for variant in (h, words.hashes(1)):
        acc = np.zeros(len(starts), np.uint64)
        for k in range(window):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + variant[starts + k]
        out.append(mix(acc))
    return out[0], out[1]


def _first_in_text(words: Words, starts: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each window, whether it is the first of its words in its text)."""
    owner = np.searchsorted(words.bounds, starts, side="right") - 1
    order = np.lexsort((starts, hb, ha, owner))
    same = ((owner[order][1:] == owner[order][:-1]) & (ha[order][1:] == ha[order][:-1]) & (hb[order][1:] == hb[order][:-1]))
    first = np.ones(len(starts), bool)
    first[order[1:]] = ~same
    return owner, first


def _summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, sha) of every row; sha is that of all words joined by one space."""

    def read(batches):
        for part in slices(batches):
            split = [t.encode().split() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string())],
                names=["doc_id", "n_words", "sha"])

    return docs.mapInArrow(read, "doc_id bigint, n_words bigint, sha string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = texts(docs).withColumn("null_id", F.col("doc_id").isNull()).withColumn(
        "doc_id", F.coalesce("doc_id", F.lit(_LEAST_ID)))
    summary = written(_summary(rows.select("doc_id", "text")))
    firsts = summary.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    several = written(firsts.where("n > 1").select("sha", "first"))
    copies = written(summary.join(several, "sha").where(F.col("doc_id") > F.col("first")).select("doc_id", "sha"))
    ids = copies.select("doc_id").distinct()
    plain = rows.select("doc_id", "text")
    if fits(ids, BROADCAST_IDS):
        # An id that has a copy and another text as well must keep the other; the copy's windows do no harm.
        single = plain.join(F.broadcast(_only(summary, ids)), "doc_id", "left_anti")
    else:
        single = written(plain.join(_only(summary, ids), "doc_id", "left_anti"))

    steps = lengths(window, shortest)
    below: list[tuple[int, Filter]] = []
    for length in steps[:-1]:
        passed = filter_of(written(_counted(single, window, length, below)))
        if passed is None:
            return _result(summary, copies, window, None)
        below.append((length, passed))
    sent = docs.sparkSession.sparkContext.broadcast(below)

    def candidates(batches):
        for part in slices(batches):
            words = Words(part.column("text"))
            h, starts = surviving(words, window, sent.value)
            if len(starts):
                ha, hb = _wide(words, starts, window, h)
                owner, first = _first_in_text(words, starts, ha, hb)
                ids = part.column("doc_id").to_numpy()[owner[first]]
                at = (starts - words.bounds[owner])[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ha[first].view(np.int64)), pa.array(hb[first].view(np.int64)), pa.array(ids),
                     pa.array(at.astype(np.int32))], names=["ha", "hb", "doc_id", "at"])

    places = single.mapInArrow(candidates, "ha bigint, hb bigint, doc_id bigint, at int")
    earliest = places.groupBy("ha", "hb").agg(F.min("doc_id").alias("id"), F.min_by("at", "doc_id").alias("at"))
    kept = earliest.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list("at").alias("kept"))

    def in_question(batches):
        for part in slices(batches):
            words = Words(part.column("text"))
            _, starts = surviving(words, window, sent.value)
            cuts = np.searchsorted(starts, words.bounds)
            own = starts - np.repeat(words.bounds[:-1], np.diff(cuts))
            out = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"),
                 pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(own.astype(np.int32)))],
                names=["doc_id", "text", "starts"])
            yield out.filter(pa.array(np.diff(cuts) > 0))

    def cut(batches):
        for part in slices(batches):
            shas, after, gone = [], [], []
            kept, starts = part.column("kept").to_numpy(False), part.column("starts").to_numpy(False)
            for text, stay, own in zip(part.column("text").to_pylist(), kept, starts):
                split = text.encode().split()
                removed = np.setdiff1d(own, stay) if stay is not None else own
                edges = np.zeros(len(split) + 1, np.int32)
                np.add.at(edges, removed, 1)
                np.add.at(edges, removed + window, -1)
                covered = np.cumsum(edges[:-1]) > 0
                shas.append(hashlib.sha256(b" ".join(split)).hexdigest())
                after.append(hashlib.sha256(b" ".join(w for w, c in zip(split, covered.tolist()) if not c)).hexdigest())
                gone.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(shas, pa.string()), pa.array(gone, pa.int64()), pa.array(after, pa.string())],
                names=["doc_id", "sha", "n_removed", "kept_sha256"])

    changed = (single.mapInArrow(in_question, "doc_id bigint, text string, starts array<int>").join(kept, "doc_id", "left")
               .mapInArrow(cut, "doc_id bigint, sha string, n_removed bigint, kept_sha256 string"))
    return _result(summary, copies, window, changed.where("n_removed > 0").dropDuplicates(["doc_id", "sha"]))


def _only(summary: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ids that have one row."""
    return summary.join(ids, "doc_id", "left_semi").groupBy("doc_id").count().where("count = 1").select("doc_id")


def _result(summary: DataFrame, copies: DataFrame, window: int, changed: DataFrame | None) -> DataFrame:
    out = summary.join(copies.distinct().withColumn("copy", F.lit(True)), ["doc_id", "sha"], "left")
    if changed is None:
        out = out.withColumn("n_removed", F.lit(None).cast("bigint")).withColumn("kept_sha256", F.lit(None).cast("string"))
    else:
        out = out.join(changed, ["doc_id", "sha"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc_id") != F.lit(_LEAST_ID), F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
