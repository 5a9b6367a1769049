"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

A text is the set of its hashed features: each word, each pair of neighbours and each pair with one
word between them. Coordinates learn at their own rate, and the L1 term keeps most of them at exactly
zero, so a fitted model is a short list of (coordinate, weight) that is cheap to send to every task.

Defined results: a text that is null or has no words has no features and scores by the bias alone; a
null doc_id is kept; repeated rows are scored each by itself; without labelled rows every score is
just under 0.5, so that nothing is predicted toxic; columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import bounded_sample, is_held_out, slices, texts
from recon.llm.words import NOT_ALNUM, Words, mix

#: Most labelled texts a fit looks at, and most that one task learns from.
MAX_LABELLED = 16_000
SHARD_ROWS = 4_000
#: Bytes of text whose features are held at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    bias_rate: float = 0.3
    epochs: int = 8
    max_labelled: int = MAX_LABELLED


@dataclass(frozen=True)
class Model:
    """Nonzero weights of a fitted classifier; at most ``2 ** bits`` of them."""

    bits: int
    bias: float
    coordinates: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.coordinates] = self.weights
        return out


def features(array: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every feature occurrence of an array of texts."""
    words = Words(array, NOT_ALNUM, fold=True)
    h = words.hashes()
    owner = np.repeat(np.arange(len(array)), np.diff(words.bounds))
    shift = np.uint64(64 - bits)
    who, what = [owner], [h >> shift]
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xD6E8FEB86659FD93)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = mix(h[:-gap] * np.uint64(salt) + h[gap:])
            who.append(owner[gap:][same])
            what.append((pair >> shift)[same])
    return np.concatenate(who), np.concatenate(what).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Follow the regularised leader over sets of coordinates; bias, nonzero coordinates, their weights.

    The bias starts at the log odds of the labels, so that the first texts do not push every coordinate
    they have, and is not regularised.
    """
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, moved = float(np.log(share / (1 - share))), 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    order = np.random.default_rng(0)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weight(at)
            error = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
            grown = np.sqrt(n[at] + error * error) - np.sqrt(n[at])
            z[at] += error - grown / s.alpha * w
            n[at] += error * error
            moved += error * error
            bias -= s.bias_rate * error / (1 + np.sqrt(moved))
    kept = np.flatnonzero(np.abs(z) > s.l1)
    return bias, kept, weight(kept)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most about ``limit`` labelled texts outside the held-out part, chosen by a hash of the id.

    (doc_id, text, label). An id labelled twice takes its larger label.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = bounded_sample(known, limit, 17)
    return texts(docs).join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn a label from a bounded sample of labelled texts.

    The sample is cut into shards of about SHARD_ROWS rows; each task learns one shard, and the
    weights of all shards are averaged. Only the nonzero averages reach the driver.
    """
    sample = labelled(docs, labels, label, settings.max_labelled)
    shards = max(1, round(min(settings.max_labelled, labels.count()) / SHARD_ROWS))

    def hashed(batches):
        for part in slices(batches, STEP_BYTES):
            who, what = features(part.column("text"), settings.bits)
            once = np.unique(who * (1 << settings.bits) + what)
            owner, what = once >> settings.bits, (once & ((1 << settings.bits) - 1)).astype(np.int32)
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(what))],
                names=["doc_id", "label", "at"])

    def learn(batches):
        rows, marks = [], []
        for batch in batches:
            marks += batch.column("label").to_pylist()
            rows += [np.asarray(v, np.int64) for v in batch.column("at").to_numpy(False)]
        if rows:
            bias, at, w = ftrl(rows, np.asarray(marks, float), settings)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))],
                                             names=["coordinate", "weight"])

    learnt = (sample.mapInArrow(hashed, "doc_id bigint, label int, at array<int>")
              .repartition(shards, F.xxhash64("doc_id", F.lit(5)))
              .sortWithinPartitions("doc_id")
              .mapInArrow(learn, "coordinate bigint, weight double"))
    sums = learnt.groupBy("coordinate").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    got = {r.coordinate: (r.weight, r.n) for r in sums.collect()}
    bias, models = got.pop(-1, (-1e-3, 1))
    at = np.fromiter(got, np.int64, len(got))
    w = np.array([x for x, _ in got.values()]) / models
    return Model(settings.bits, bias / models, at, w.astype(np.float32))


def logits(array: pa.Array, dense: np.ndarray, bits: int, bias: float) -> np.ndarray:
    """Sum of the weights of each text's feature set; features of weight zero are dropped before sorting."""
    who, what = features(array, bits)
    hit = dense[what] != 0
    once = np.unique(who[hit] * (1 << bits) + what[hit])
    return np.bincount(once >> bits, dense[once & ((1 << bits) - 1)], minlength=len(array)) + bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; whole texts, one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = sent.value
        dense, bits = model.dense(), model.bits
        for part in slices(batches, STEP_BYTES):
            total = np.clip(logits(part.column("text"), dense, bits, model.bias), -35, 35)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(scored, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, "toxic", settings)
    return score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    model = fit(docs, labels, "toxic", settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.columns

    def kept(batches):
        model = sent.value
        dense, bits = model.dense(), model.bits
        for part in slices(batches, STEP_BYTES):
            yield part.filter(pa.array(logits(part.column("text"), dense, bits, model.bias) < 0))

    return docs.select(*fields).mapInArrow(kept, docs.schema)
