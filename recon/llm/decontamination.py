"""Which words of documents stand in passages of a benchmark, by winnowed fingerprints.

Words are what is left of a text between ASCII marks and white space, with A-Z lower-cased. A window is
``WINDOW`` consecutive words of an item, or the whole item where it has fewer. Of the hashes of the k-grams in
each window the least is kept (the first of equal ones), in documents and in items alike, so a window they share
has a fingerprint they share: nothing of at least the window's length can be missed. A document's kept
fingerprints are joined with those of the benchmark; around each hit the windows that may hold it are compared by
128-bit hashes, and the words of equal ones are marked. Items with fewer than ``WINDOW`` words are handled in
the same way at their own length (one to nine words); k is ``GRAM`` or the length, if that is less.

A benchmark of at most ``MOST_BROADCAST`` distinct windows goes to every task as sorted arrays of hashes
(40 bytes a window), and a document is judged where it is read, without a shuffle. A larger one is joined by
shuffles: kept fingerprints first, which are two in seven of the k-grams, then the windows around the hits.
Both ways give the same rows.

Items come in through classes of windows: windows that stand in the same set of items are one class, known by
order-free digests of that set, so that copied items do not multiply rows. Documents with the same classes share
one list of items.

Results of odd input: a null or empty text has no words and is not contaminated. A null item text is no window;
an item without an id marks words but is not counted or named. Rows with the same item_id are one item of several
texts. Repeated documents each have their row, a null doc_id is kept. An empty benchmark contaminates nothing.
Ties: equal hashes in a window keep the first place. Further columns are not read. A text is read whole, however
long: one of more than ``SLICE_BYTES`` is a step of its own and takes about 50 bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm.common import slices, texts, written
from recon.llm.words import NOT_ALNUM, Words, mix, windows
from recon.operators.joins import salted_lookup

WINDOW = 10
GRAM = 5
#: Distinct benchmark windows up to which their hashes are broadcast: 20 MB at most.
MOST_BROADCAST = 500_000

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, classes array<bigint>"
_WINDOW_ROWS = "item_id string, length int, h1 bigint, h2 bigint, fp bigint"


def gram_of(length: int) -> int:
    return min(GRAM, length)


def kept_grams(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (hash, word it starts at) of the kept k-grams, and for every window of ``length`` words
    the kept one's hash. Windows are in the order of ``windows(hashes, bounds, length)``."""
    k = gram_of(length)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9FB21C651E98DF25) + hashes[j: j + n]
    gram = mix(gram)
    starts = windows(hashes, bounds, length)[1]
    best, at = gram[starts], starts.copy()
    for j in range(1, length - k + 1):
        other = gram[starts + j]
        less = other < best
        best[less] = other[less]
        at[less] = starts[less] + j
    places = np.unique(at)
    return gram[places], places, best


def window_hashes(words: Words, first: np.ndarray, second: np.ndarray, starts: np.ndarray, length: int):
    """Two hashes of the windows that start at given words."""
    out = []
    for hashes, salt in ((first, np.uint64(length)), (second, np.uint64(length + 64))):
        acc = np.full(len(starts), salt, np.uint64)
        for j in range(length):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[starts + j]
        out.append(mix(acc))
    return out


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of every item: (item_id as text, length, h1, h2, fp)."""

    def cut(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_ALNUM, fold=True)
            first, second = words.hashes(0), words.hashes(1)
            counts = np.diff(words.bounds)
            item = np.repeat(np.arange(batch.num_rows), counts)
            for length in sorted({min(int(c), WINDOW) for c in counts if c}):
                mine = np.flatnonzero((counts == length) | ((length == WINDOW) & (counts > WINDOW)))
                # Only words of items of this length: others become empty texts.
                keep = np.isin(item, mine)
                sizes = np.where(np.isin(np.arange(batch.num_rows), mine), counts, 0)
                bounds = np.append(0, np.cumsum(sizes))
                f, s = first[keep], second[keep]
                starts = windows(f, bounds, length)[1]
                h1, h2 = window_hashes(words, f, s, starts, length)
                fp = kept_grams(f, bounds, length)[2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(item[keep][starts])),
                     pa.array(np.full(len(starts), length, np.int32)),
                     *(pa.array(a.view(np.int64)) for a in (h1, h2, fp))], names=["item_id", "length", "h1", "h2", "fp"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("text IS NOT NULL").mapInArrow(cut, _WINDOW_ROWS)


def _class(salt: int) -> Column:
    """Order-free digest of a group's distinct items; one without id adds nothing."""
    return F.coalesce(F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64(F.lit(salt), "item_id"))), F.lit(0))


def window_classes(pairs: DataFrame) -> DataFrame:
    """(length, h1, h2, fp, class) of every distinct window, of distinct (window, item) pairs."""
    whole = pairs.groupBy("length", "h1", "h2", "fp").agg(F.count("item_id").alias("n"), _class(1).alias("x"), _class(2).alias("y"))
    return whole.select("length", "h1", "h2", "fp", F.xxhash64("n", "x", "y").alias("class"))


def _marked(hits: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Which of ``size`` words lie inside a window, from the starts by length."""
    steps = np.zeros(size + 1, np.int32)
    for length, starts in hits.items():
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _candidates(kept_at: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that hold a k-gram starting at one of the given words."""
    text = np.searchsorted(bounds, kept_at, side="right") - 1
    low, high = bounds[text], bounds[text + 1] - length
    spread = kept_at[:, None] - np.arange(length - gram_of(length) + 1)
    return np.unique(spread[(spread >= low[:, None]) & (spread <= high[:, None])])


class _Index:
    """Windows of a benchmark as sorted arrays, by length."""

    def __init__(self, table: pa.Table):
        self.by_length = {}
        length = table.column("length").to_numpy()
        columns = {c: table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "fp")}
        classes = table.column("class").to_numpy()
        for size in np.unique(length):
            mine = np.flatnonzero(length == size)
            order = mine[np.lexsort((columns["h2"][mine], columns["h1"][mine]))]
            self.by_length[int(size)] = (np.unique(columns["fp"][mine]), columns["h1"][order], columns["h2"][order], classes[order])

    def hits(self, words: Words) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Starts of windows that stand in the benchmark, by length; start and class of each."""
        first = words.hashes(0)
        starts, at, classes = {}, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        second = None
        for length, (fps, h1, h2, cls) in self.by_length.items():
            gram, places, _ = kept_grams(first, words.bounds, length)
            places = places[_in_sorted(gram, fps)]
            if not len(places):
                continue
            if second is None:
                second = words.hashes(1)
            near = _candidates(places, words.bounds, length)
            a, b = window_hashes(words, first, second, near, length)
            row = np.searchsorted(h1, a)
            found = np.zeros(len(near), bool)
            place = np.zeros(len(near), np.int64)
            # Windows with the same first hash lie next to each other; two already are a rarity.
            while True:
                live = np.flatnonzero((row < len(h1)) & ~found)
                live = live[h1[row[live]] == a[live]]
                if not len(live):
                    break
                equal = live[h2[row[live]] == b[live]]
                found[equal], place[equal] = True, row[equal]
                row[live] += 1
            starts[length] = near[found]
            at.append(near[found])
            classes.append(cls[place[found]])
        return starts, np.concatenate(at), np.concatenate(classes)


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    row = np.searchsorted(among, values)
    return among[np.minimum(row, len(among) - 1)] == values


def _by_broadcast(docs: DataFrame, found: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_Index(found.toArrow()))

    def judge(batches):
        index = shared.value
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_ALNUM, fold=True)
            bounds = words.bounds
            starts, at, classes = index.hits(words)
            total = np.append(0, np.cumsum(_marked(starts, len(words)))) if len(words) else np.zeros(1, np.int64)
            text = np.searchsorted(bounds, at, side="right") - 1
            each = np.unique(np.stack([text, classes], axis=1), axis=0) if len(at) else np.empty((0, 2), np.int64)
            ends = np.searchsorted(each[:, 0], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(each[:, 1])),
            ], names=["doc_id", "n_words", "n_hit", "classes"])

    return texts(docs).mapInArrow(judge, RESULT)


def _by_shuffle(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The same rows where the benchmark is too large to broadcast; documents get a written row number."""
    docs = written(texts(docs).withColumn("place", F.monotonically_increasing_id()))
    lengths = sorted(r.length for r in found.select("length").distinct().collect())

    def keep(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_ALNUM, fold=True)
            first = words.hashes(0)
            for length in lengths:
                gram, places, _ = kept_grams(first, words.bounds, length)
                text = np.searchsorted(words.bounds, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("place").take(pa.array(text)), pa.array(np.full(len(gram), length, np.int32)),
                    pa.array(gram.view(np.int64)), pa.array(places - words.bounds[text])], names=["place", "length", "fp", "at"])

    kept = docs.mapInArrow(keep, "place bigint, length int, fp bigint, at bigint")
    shared = kept.join(found.select("length", "fp").distinct(), ["length", "fp"], "left_semi")
    # A list holds places of one text, so it is no longer than the text.
    near = shared.groupBy("place").agg(F.collect_list(F.struct("length", "at")).alias("near"))

    def look(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_ALNUM, fold=True)
            first, second = words.hashes(0), words.hashes(1)
            lists = batch.column("near")
            flat = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = flat.field("at").to_numpy() + words.bounds[text]
            length_of = flat.field("length").to_numpy()
            for length in np.unique(length_of).tolist():
                starts = _candidates(np.unique(at[length_of == length]), words.bounds, length)
                a, b = window_hashes(words, first, second, starts, length)
                of = np.searchsorted(words.bounds, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("place").take(pa.array(of)), pa.array(np.full(len(starts), length, np.int32)),
                    pa.array(starts - words.bounds[of]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    names=["place", "length", "at", "h1", "h2"])

    around = docs.join(near, "place").mapInArrow(look, "place bigint, length int, at bigint, h1 bigint, h2 bigint")
    hits = around.join(found.select("length", "h1", "h2", "class"), ["length", "h1", "h2"])

    def mark(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_ALNUM, fold=True)
            bounds = words.bounds
            lists = batch.column("hits")
            flat = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = flat.field("at").to_numpy().astype(np.int64) + bounds[text]
            length_of = flat.field("length").to_numpy()
            starts = {int(n): at[length_of == n] for n in np.unique(length_of)}
            total = np.append(0, np.cumsum(_marked(starts, len(words)))) if len(words) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)), batch.column("classes")],
                names=["doc_id", "n_words", "n_hit", "classes"])

    by_text = hits.groupBy("place").agg(F.collect_list(F.struct("length", "at")).alias("hits"),
                                        F.sort_array(F.collect_set("class")).alias("classes"))
    none = F.array().cast("array<bigint>")
    all_docs = docs.join(by_text, "place", "left").select(
        "doc_id", "text", F.coalesce("hits", F.array().cast("array<struct<length:int,at:bigint>>")).alias("hits"),
        F.coalesce("classes", none).alias("classes"))
    return all_docs.mapInArrow(mark, RESULT)


def hit_words(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, n_hit, classes) of every document, written; and (class, item_id) of every class."""
    pairs = written(item_windows(benchmark).distinct())
    found = written(window_classes(pairs))
    judge = _by_broadcast if found.count() <= most_broadcast else _by_shuffle
    judged = written(judge(docs, found))
    # One window stands for its class: all of them have the same items.
    one = found.groupBy("class").agg(F.min(F.struct("length", "h1", "h2")).alias("w")).select("class", "w.*")
    named = one.join(pairs.where("item_id IS NOT NULL"), ["length", "h1", "h2"]).select("class", "item_id").distinct()
    return judged, named


def contamination(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (their sorted ids)."""
    judged, named = hit_words(docs, benchmark, most_broadcast)
    hit = judged.where(F.size("classes") > 0).withColumn("key", F.md5(F.concat_ws(",", "classes")))
    lists = hit.groupBy("key").agg(F.min("classes").alias("classes"))
    items = (lists.select("key", F.explode("classes").alias("class")).join(named, "class")
             .select("key", "item_id").distinct().groupBy("key")
             .agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    # Copies of one document have one list: rows are spread over salts, so that a key of many rows is split.
    listed = salted_lookup(hit, items.withColumnRenamed("key", "of"), "key", "of", F.monotonically_increasing_id())
    clean = judged.where(F.size("classes") == 0).withColumn("items", F.lit(None).cast("array<string>"))
    of_items = F.coalesce("items", F.array().cast("array<string>"))
    return listed.select(clean.columns).unionByName(clean).select(
        "doc_id", "n_words", "n_hit", F.size(of_items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", of_items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        of_items.alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0) -> DataFrame:
    """Documents of which at most ``most_share`` of the words stand in benchmark passages, with all their columns."""
    keyed = written(docs.withColumn("_place", F.monotonically_increasing_id()))
    rows = keyed.select(F.col("_place").alias("doc_id"), "text")
    judged = hit_words(rows, benchmark)[0].where(F.col("n_hit") > F.col("n_words") * most_share)
    return keyed.join(judged.select(F.col("doc_id").alias("_place")), "_place", "left_anti").drop("_place")
