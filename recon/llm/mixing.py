"""Mixing sources to target weights: soft domains, and rates that make their expected tokens match.

A classifier fitted to a labelled table gives each document a posterior over domains. Rates say how often
a document is taken; the expected tokens of a domain are the sum over documents of rate, tokens and
posterior. Rates of at least ``least`` are fitted to the target totals by projected-gradient least squares:
the misfit of the domains, whitened by the Gram matrix of the posteriors, plus a small pull to rate 1 that makes the
answer unique. After the last step each domain that misses its total by more than MISFIT of it is reported by a
warning; so are totals below what ``least`` leaves of a domain. A weight of 0 asks for no more of a domain than ``least``
leaves, and the others share the rest. A step needs one aggregation of a few sums over all documents; no state is kept for a
document, as its rate follows from its posterior and the short history of misfits.

The posterior is naive Bayes over hashed words and runs of marks. Counts cover at most TEACHING_ROWS labelled
documents, chosen by a hash, outside the held-out part and another fifth; the log ratios are divided by a temperature, chosen on a bounded sample of that
fifth, as words of one text are not independent.

Domains: ``clean`` (quality 1, not toxic), ``poor`` (quality 0, not toxic) and ``toxic``. Tokens are counted as
words.

Defined results: a null or empty text has no tokens, the prior as posterior, and the rate of any such
document; null ids are kept; repeated rows are rated each by itself; rows without labels do not teach; a
domain without labelled documents has posterior near 0 and is left out of the fit; without documents
there are no rows. Other columns are not read, and are kept by ``resample``.
"""

from __future__ import annotations

import functools
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm.common import bounded_sample, is_held_out, slices, texts, written
from recon.llm.words import NOT_ALNUM, WHITE, Words
from recon.llm.words import mix as mix64

DOMAINS = ("clean", "poor", "toxic")
#: Shares of tokens asked for, by domain.
TARGET = (0.80, 0.18, 0.02)
BITS = 18
#: What separates runs of marks: white space, letters and digits, and bytes of other scripts.
NOT_MARK = WHITE + bytes(b for b in range(256) if b not in NOT_ALNUM)
#: Bytes of text a step works on: its words and marks take many times as much, in each of an executor's workers.
STEP_BYTES = 1 << 20
SMOOTHING = 0.5
#: Labelled documents, at most about so many, that words are counted in.
TEACHING_ROWS = 20_000
#: Labelled documents the temperature is chosen on.
CALIBRATION_ROWS = 4_000
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 128, 256)
STEPS = 40
PULL = 0.01
CLOSE = 1e-4
#: A domain that misses its total by more than this share of it is reported.
MISFIT = 0.05


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number) of labelled ids outside the held-out part; of labels that differ the worst counts."""
    toxic, poor = F.max(F.col("toxic").cast("int")), F.min(F.col("quality").cast("int"))
    return (labels.where("doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(toxic.alias("t"), poor.alias("q"))
            .select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).when(F.col("q") == 1, 0).alias("domain"))
            .where("domain IS NOT NULL"))


def _streams(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, bounds) of the words of each text, and of its runs of marks between them."""
    words, marks = Words(array, NOT_ALNUM, fold=True), Words(array, NOT_MARK)
    shift = np.uint64(64 - BITS)
    return [((words.hashes() >> shift).astype(np.int64), words.bounds),
            ((mix64(marks.hashes()) >> shift).astype(np.int64), marks.bounds)]


def word_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, coordinate, n) over the labelled documents of a bounded table; coordinate -1 counts the documents."""

    def counted(batches):
        table = np.zeros((len(DOMAINS), 1 << BITS), np.int64)
        rows = np.zeros(len(DOMAINS), np.int64)
        for part in slices(batches, STEP_BYTES):
            domain = part.column("domain").to_numpy()
            for at, bounds in _streams(part.column("text")):
                np.add.at(table, (np.repeat(domain, np.diff(bounds)), at), 1)
            rows += np.bincount(domain, minlength=len(DOMAINS))
        d, c = np.nonzero(table)
        every = np.arange(len(DOMAINS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(d, every), pa.int32()), pa.array(np.append(c, every * 0 - 1)),
             pa.array(np.append(table[d, c], rows))], names=["domain", "coordinate", "n"])

    return (docs.join(F.broadcast(known), "doc_id").select("text", F.col("domain").cast("int").alias("domain"))
            .mapInArrow(counted, "domain int, coordinate bigint, n bigint")
            .groupBy("domain", "coordinate").agg(F.sum("n").alias("n")))


class Posterior:
    """Posterior over domains of texts, from sums of log likelihood divided by a temperature."""

    def __init__(self, counts: np.ndarray, rows: np.ndarray):
        smooth = counts + SMOOTHING
        self.log = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).astype(np.float32)
        self.prior = np.log((rows + 1e-6) / (rows.sum() + len(rows) * 1e-6)) if rows.sum() else np.zeros(len(rows)) - np.log(len(rows))
        self.temperature = 1.0

    def sums(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods by domain, words) of each text."""
        out, streams = np.zeros((len(array), len(DOMAINS))), _streams(array)
        for d in range(len(DOMAINS)):
            for at, bounds in streams:
                total = np.concatenate([[0.0], np.cumsum(self.log[d][at], dtype=float)])
                out[:, d] += total[bounds[1:]] - total[bounds[:-1]]
        return out, np.diff(streams[0][1])

    def of(self, sums: np.ndarray, temperature: float | None = None) -> np.ndarray:
        x = self.prior + sums / (temperature or self.temperature)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def fit_posterior(docs: DataFrame, labels: DataFrame) -> Posterior:
    """Learn the posterior; the driver gets a table of fixed size and the sums of CALIBRATION_ROWS texts."""
    rows, known = texts(docs), written(domains(labels))
    spared = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4
    found = word_counts(rows, bounded_sample(known.where(~spared), TEACHING_ROWS, 19)).toArrow()
    counts, n = np.zeros((len(DOMAINS), 1 << BITS)), np.zeros(len(DOMAINS))
    d, c, v = (found.column(k).to_numpy() for k in ("domain", "coordinate", "n"))
    n[d[c < 0]] = v[c < 0]
    counts[d[c >= 0], c[c >= 0]] = v[c >= 0]
    model = Posterior(counts, n)
    few = bounded_sample(known.where(spared), CALIBRATION_ROWS, 23)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for part in slices(batches, STEP_BYTES):
            yield pa.RecordBatch.from_arrays(
                [part.column("domain"), _lists(sent.value.sums(part.column("text"))[0])], names=["domain", "sums"])

    own = (rows.join(F.broadcast(few), "doc_id").select("text", F.col("domain").cast("int").alias("domain"))
           .mapInArrow(scored, "domain int, sums array<double>").toArrow())
    if own.num_rows:
        truth, sums = own.column("domain").to_numpy(), np.array(own.column("sums").to_pylist())
        loss = {t: -np.log(np.maximum(model.of(sums, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in TEMPERATURES}
        model.temperature = min(loss, key=loss.get)
    return model


def _lists(matrix: np.ndarray) -> pa.ListArray:
    cuts = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(matrix.ravel()))


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """(doc_id, n_tokens, p) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for part in slices(batches, STEP_BYTES):
            sums, words = sent.value.sums(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words, pa.int64()), _lists(sent.value.of(sums))],
                names=["doc_id", "n_tokens", "p"])

    return texts(docs).mapInArrow(scored, "doc_id bigint, n_tokens bigint, p array<double>")


def _dot(p: Column, numbers) -> Column:
    return functools.reduce(lambda a, b: a + b, [F.get(p, F.lit(k)) * float(x) for k, x in enumerate(numbers)])


def rate(p: Column, history: list[np.ndarray], least: float, step: float) -> Column:
    """The rate of a posterior after the steps of a history, each moving it by its gradient and back into bounds."""
    if not history:
        return F.lit(1.0)
    # One term a step: how much the domains' misfits say that this posterior is taken too often.
    terms = F.array(*[_dot(p, g) for g in history])
    return F.aggregate(terms, F.lit(1.0), lambda r, g: F.greatest(F.lit(least), r - step * (g + PULL * (r - 1.0))))


def fit_rates(scored: DataFrame, target: np.ndarray, least: float) -> tuple[list[np.ndarray], float, np.ndarray]:
    """History of misfits that gives the rates, and the misfit left; ``target`` has the domains' totals in tokens."""
    k = len(DOMAINS)
    p, w = F.col("p"), F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(k)]
    row = scored.agg(F.sum(w).alias("t"), *[F.sum(w * F.get(p, F.lit(i)) * F.get(p, F.lit(j))).alias(f"m{i}{j}") for i, j in pairs]).first()
    if not row.t:
        return [], 1.0, np.zeros(k)
    gram = np.array([[row[f"m{i}{j}"] for j in range(k)] for i in range(k)]) / row.t
    white = np.linalg.pinv(gram + 1e-6 * np.eye(k))
    goal, step, history = np.asarray(target) / row.t, 1.0 / (1.0 + PULL), []

    def misfit_of(history: list[np.ndarray]) -> np.ndarray:
        r = rate(p, history, least, step)
        got = scored.select(w.alias("w"), "p", r.alias("r")).agg(
            *[F.sum(F.col("w") * F.col("r") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        return np.array([got[f"s{i}"] for i in range(k)]) / row.t - goal

    for _ in range(STEPS):
        misfit = misfit_of(history)
        gradient = white @ misfit
        if history and np.abs(gradient - history[-1]).max() < CLOSE:
            break
        history.append(gradient)
        if np.abs(misfit).max() < CLOSE:
            break
    return history, step, misfit_of(history) * row.t


def report(target: np.ndarray, misfit: np.ndarray, weights: tuple[float, ...]) -> None:
    """Warn of each domain with a weight that misses its total by more than MISFIT of it."""
    missed = [f"{d} {100 * m / t:+.1f} %" for d, t, m, x in zip(DOMAINS, target, misfit, weights) if x and t and abs(m) > MISFIT * t]
    if missed:
        warnings.warn(f"mixing misses its totals: {', '.join(missed)}", stacklevel=3)


def targets(scored: DataFrame, weights: tuple[float, ...], growth: float, budget: float | None, least: float) -> np.ndarray:
    """Totals by domain: the weights of a budget, by default of ``growth`` times all tokens there are."""
    w = F.col("n_tokens")
    row = scored.agg(F.sum(w), *[F.sum(w * F.get("p", F.lit(i))) for i in range(len(DOMAINS))]).first()
    # A domain without weight keeps what every row's least rate leaves of it.
    x = np.asarray(weights, float)
    kept = np.where(x == 0, least * np.array([v or 0.0 for v in row[1:]]), 0.0)
    return kept + x / x.sum() * max(0.0, (budget or growth * float(row[0] or 0)) - kept.sum())


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = TARGET, budget: float | None = None,
        least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every row."""
    scored = written(posteriors(docs, fit_posterior(docs, labels)))
    goal = targets(scored, weights, 1.0, budget, least)
    history, step, misfit = fit_rates(scored, goal, least)
    report(goal, misfit, weights)
    # A rate between two numbers is rounded up for as large a share of ids, by their hash.
    u = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) / F.lit(2.0**32)
    copies = F.floor(F.col("rate") + u).cast("int")
    return (scored.withColumn("rate", rate(F.col("p"), history, least, step))
            .select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
                    "rate", copies.alias("copies")))


def resample(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = TARGET, growth: float = 1.0,
             least: float = 0.0) -> DataFrame:
    """``docs``, each row as often as its rate says; the budget is ``growth`` times the tokens there are."""
    model = fit_posterior(docs, labels)
    scored = written(posteriors(docs, model))
    goal = targets(scored, weights, growth, None, least)
    history, step, misfit = fit_rates(scored, goal, least)
    report(goal, misfit, weights)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def taken(batches):
        for part in slices(batches, STEP_BYTES):
            p = sent.value.of(sent.value.sums(part.column("text"))[0])
            r = np.ones(len(p))
            for g in history:
                r = np.maximum(least, r - step * (p @ g + PULL * (r - 1.0)))
            u = np.array([zlib.crc32(f"{i}".encode()) / 2**32 for i in part.column("doc_id").to_pylist()])
            yield part.take(pa.array(np.repeat(np.arange(len(p)), np.floor(r + u).astype(int))))

    return docs.mapInArrow(taken, docs.schema)
