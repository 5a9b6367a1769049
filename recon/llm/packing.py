"""Packing: minimum bin slack over the token lengths of documents.

A document's ids and an end mark are cut into full windows from its start; what is left over, shorter
than a window, waits to be packed. Left-overs are dealt into pools of bounded size by a hash. In a
pool, a bitset holds every total that some multiset of the lengths still waiting can reach; the
reachable total closest to the capacity is chosen, the multiset is read back from the bitsets, and
it fills as many windows as the counts of its lengths allow, before the next one is looked for.

Defined results: a null or empty text is one piece that holds the end mark alone; a null doc_id is
kept; rows that repeat are packed each by itself; other columns are not read; without rows there are
no pieces. Each id lies in exactly one piece. sequence_id is unique, not gapless.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import SLICE_BYTES, slices, texts, written

CAPACITY = 4096
END_ID = 2
#: Left-overs a pool has on average.
POOL = 4_000
#: Parts of words whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 500_000
#: Words of a line, and lines of a call, that are encoded together.
LINE = 100
#: ASCII marks that follow a word's letters as a pre-token of their own. An apostrophe may belong to the letters.
_CLOSING = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Latin letters whose lower case is one Latin letter too: a run of them is one pre-token.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250")


class WordEncoder:
    """Ids of a text from the ids of its words, each distinct part of a word encoded once.

    The tokenizer lower-cases, drops white space before it merges, and its special strings hold none,
    so a text's ids are those of its words in a row. Words are cut at ASCII white space. A run of letters and the
    marks that close it are two parts, as they are two pre-tokens; any other word is one part. What is remembered
    lies in Arrow and numpy arrays: parts, their ids in a row, and where each part's ids begin.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        # The same merges, held once, for runs of letters with blanks between them.
        self._runs = Tokenizer(self._tokenizer.model)
        self._runs.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        suffix = self._tokenizer.model.end_of_word_suffix
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self._parts = pa.array([], pa.string())
        self._ids = np.empty(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _encoded_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids a word) of runs of letters; the last id of a word is one that closes words."""
        lines = [" ".join(words[i: i + LINE]) for i in range(0, len(words), LINE)]
        flat = [np.array(x.ids, np.uint32) for i in range(0, len(lines), LINE)
                for x in self._runs.encode_batch_fast(lines[i: i + LINE], add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.uint32), *flat])
        ends = np.flatnonzero(self._closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not close each word by an id of its own")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Where each of the new parts is remembered."""
        known = len(self._parts)
        letters = pc.match_substring_regex(new, f"^[{_LETTERS}]+$")
        runs, other = new.filter(letters), new.filter(pc.invert(letters))
        ids, sizes = self._encoded_runs([w.lower() for w in runs.to_pylist()])
        rest = [x.ids for x in self._tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
        more = np.fromiter(map(len, rest), np.int64, len(rest))
        self._parts = pa.concat_arrays([self._parts, runs, other])
        self._ids = np.concatenate([self._ids, ids, np.fromiter(chain.from_iterable(rest), np.uint32, int(more.sum()))])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(np.concatenate([sizes, more]))])
        first = letters.to_numpy(zero_copy_only=False)
        return known + np.where(first, np.cumsum(first), len(runs) + np.cumsum(~first)) - 1

    @staticmethod
    def _split(texts: pa.Array) -> pa.ListArray:
        # Lower case of ASCII only. With capitals made small, a special string could arise that was not there.
        special = pc.match_substring(texts, "<|")
        return pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))

    @staticmethod
    def _halves(words: pa.Array) -> pa.Array:
        """Two parts a word, one after the other: a run of letters and its closing marks, or the word and nothing."""
        stems = pc.ascii_rtrim(words, characters=_CLOSING)
        run = pc.match_substring_regex(stems, f"^[{_LETTERS}]+$")
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset: words.offset + len(words) + 1]
        cuts = np.repeat(offsets, 2)[:-1]
        cuts[1::2] = np.where(run.to_numpy(zero_copy_only=False), offsets[:-1] + pc.binary_length(stems).to_numpy(), offsets[1:])
        return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), data)

    def __call__(self, values: pa.Array | list[str]) -> list[np.ndarray]:
        if not len(values):
            return []
        split = self._split(pa.array(values, pa.string()) if isinstance(values, list) else values.cast(pa.string()).fill_null(""))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        halves = self._halves(words.dictionary).dictionary_encode()
        known = pc.index_in(halves.dictionary, value_set=self._parts).fill_null(-1).to_numpy().copy()
        if len(self._parts) + (known < 0).sum() > REMEMBERED:
            self._reset()
            known[:] = -1
        if (known < 0).any():
            known[known < 0] = self._learn(halves.dictionary.filter(pa.array(known < 0)))
        at = known[halves.indices.to_numpy()].reshape(-1, 2)[words.indices.to_numpy()].ravel()
        start, size = self._ends[at], self._ends[at + 1] - self._ends[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self._ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[2 * bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, which later tasks find with the words it has learnt."""
    return WordEncoder(path)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, pool_key) of every piece; only the last may be short."""

    def pieces(batches):
        encode = encoder(tokenizer_path)
        for part in slices(batches, SLICE_BYTES // 2):
            out = defaultdict(list)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    own = ids[start: start + capacity]
                    crc = zlib.crc32(own.tobytes())
                    for k, v in zip(_PIECE, (doc_id, start, len(own), crc, len(ids))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], pa.int64()) for k in _PIECE})

    return texts(docs).mapInArrow(pieces, ", ".join(f"{k} bigint" for k in _PIECE))


_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def closest_fill(counts: dict[int, int], capacity: int) -> list[int]:
    """A multiset of the lengths whose total is the largest that is at most the capacity.

    Lengths go in descending order, each as often as it fits; bit t of a step's set says that total t
    can be reached with the lengths up to that step. Walking back takes a step's length only where
    the total cannot be reached without it.
    """
    reach, steps = 1, []
    full = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        block = 1
        while left:  # 1, 2, 4, ... copies at once reach every count
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            block *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pack positions of ``lengths`` (each from 1 to the capacity) into windows."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for at, length in enumerate(lengths):
        waiting[length].append(at)
    counts = {k: len(v) for k, v in waiting.items()}
    out = []
    while counts:
        chosen = Counter(closest_fill(counts, capacity))
        for _ in range(min(counts[k] // n for k, n in chosen.items())):
            out.append([waiting[k].pop() for k, n in chosen.items() for _ in range(n)])
            for k, n in chosen.items():
                counts[k] -= n
        counts = {k: v for k, v in counts.items() if v}
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         pool: int = POOL) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    pieces = written(cut(docs, tokenizer_path, capacity, end_id))
    short = pieces.where(F.col("length") < capacity)
    pools = max(1, round(short.count() / pool))
    keyed = pieces.withColumn("pool", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "ids_crc32"), F.lit(pools)))
    # Full windows need no pool: each is a sequence, numbered within its own partition.
    whole = (keyed.where(F.col("length") == capacity)
             .withColumn("sequence_id", F.monotonically_increasing_id() * 2)
             .withColumn("offset", F.lit(0).cast("bigint")).drop("pool"))

    def packed(key, table):
        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, members in enumerate(fill(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = 2 * (key[0].as_py() * (1 << 32) + number) + 1, at
                at += lengths[i]
        return table.drop(["pool"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64()))

    rest = (keyed.where(F.col("length") < capacity).groupBy("pool")
            .applyInArrow(packed, whole.schema))
    return whole.unionByName(rest)
