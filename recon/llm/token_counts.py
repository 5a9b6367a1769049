"""Token counts: pieces are counted once per distinct pre-token and summed over each text's pre-tokens.

For a sentencepiece BPE model none of whose pieces has the space mark after another character, no
merge crosses from a character to a space mark. A normalised text is then a row of pre-tokens, each a
run of space marks and what follows up to the next, and the token count of the text is the sum of
theirs. Ids are never made for a text.

The corpus's pre-tokens are counted in one aggregation. The most frequent ones, at most HEAD of them and
none longer than HEAD_CHARS, form the table of piece counts that is broadcast: a documented bound,
whatever the corpus. The rest, which a corpus has without bound and mostly once, are counted by the
task that meets them, once per task; sending each through a shuffle instead would move more bytes
than the text has, for the same counts.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows are
counted each by itself; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import slices, texts, written

HEAD = 200_000
HEAD_CHARS = 64
#: Pre-tokens a task holds before it passes their counts on, or forgets those it has counted itself.
HELD = 400_000
_PRE_TOKEN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows; the model puts one space before a text, and reads U+2581 as one."""
    return _PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class PieceCounter:
    """Counts the pieces of one pre-token."""

    def __init__(self, model_path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._space = len(self._model.encode("a ")) - len(self._model.encode("a"))

    def __call__(self, found: list[str]) -> list[int]:
        # The model adds one space itself; of a single space nothing is left then.
        ids = self._model.encode([x[1:] for x in found], num_threads=1)
        return [len(x) if len(t) > 1 else self._space for t, x in zip(found, ids)]


def frequencies(docs: DataFrame) -> DataFrame:
    """(pre_token, n) over all texts. Each task adds up its own before anything is shuffled."""

    def counted(batches):
        seen: Counter[str] = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                seen.update(pre_tokens(text))
            if len(seen) > HELD:
                yield pa.RecordBatch.from_pydict({"pre_token": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pa.RecordBatch.from_pydict(
            {"pre_token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return (texts(docs).select("text").mapInArrow(counted, "pre_token string, n bigint")
            .groupBy("pre_token").agg(F.sum("n").alias("n")))


def piece_table(found: DataFrame, model_path: str) -> DataFrame:
    """(pre_token, pieces): every pre-token of the frame is encoded once."""

    def pieces(batches):
        count = PieceCounter(model_path)
        for part in slices(batches, column="pre_token"):
            own = part.column("pre_token")
            yield pa.RecordBatch.from_arrays([own, pa.array(count(own.to_pylist()), pa.int32())],
                                             names=["pre_token", "pieces"])

    return found.select("pre_token").mapInArrow(pieces, "pre_token string, pieces int")


def head_of(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent pre-tokens, at most ``limit``: those above the least power of two that fits."""
    short = counts.where(F.length("pre_token") <= HEAD_CHARS)
    grade = F.floor(F.log2("n")).cast("int")
    sizes = {r.grade: r["count"] for r in short.groupBy(grade.alias("grade")).count().collect()}
    total, least = 0, 64
    for g in sorted(sizes, reverse=True):
        total += sizes[g]
        if total > limit:
            break
        least = g
    return short.where(grade >= least)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    counts = written(frequencies(docs))
    table = {r.pre_token: r.pieces for r in piece_table(head_of(counts, head), model_path).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def summed(batches):
        known, own, count = sent.value, {}, PieceCounter(model_path)
        for part in slices(batches):
            values = part.column("text").to_pylist()
            split = [Counter(pre_tokens(t)) for t in values]
            new = list({t for freq in split for t in freq if t not in known and t not in own})
            if len(own) + len(new) > HELD:
                own.clear()
                new = list({t for freq in split for t in freq if t not in known})
            own.update(zip(new, count(new)))
            totals = [sum((known[t] if t in known else own[t]) * n for t, n in freq.items()) for freq in split]
            sizes = [len(t.encode()) for t in values]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    out = texts(docs).mapInArrow(summed, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
