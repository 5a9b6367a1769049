"""Exact top-k by inner product: one KD-tree per shard, searched best box first.

Rows are dealt into shards of bounded size. The task of a shard builds its KD-tree: nodes are split at
the median of their widest dimension and keep tight bounding boxes. No vector of a box can score above the
sum over dimensions of the better of its two sides, so a query visits boxes from the highest bound
down, and stops where no box can reach its k-th best score. A first pass answers each query from its
own shard alone; the k-th score found there goes with the query to all other shards, where most boxes
then need no visit.

Queries are a stated set and meet the shards in blocks. Components become floor(scale * x) and scores
are integers, so ties are exact and go to the smaller id.

Defined results: null vectors, and vectors that hold a null or a component that is not finite, take no
part, as rows or as queries; nor do rows without an id. Vectors meet those of their own length only.
Rows that share an id are candidates each by itself, but never for a query of their own id; an id that
repeats asks once, with the least of its vectors. Components beyond
2^25 after scaling are an error, as a score would leave 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.llm.common import written

SHARD_ROWS = 8_000
LEAF_ROWS = 128
QUERY_BLOCK = 256
QUERY_ROWS = 2_000
LARGEST = 1 << 25


class Tree:
    """KD-tree over integer vectors; node i has the rows ``order[first[i]:last[i]]``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.first, self.last, self.children, lows, highs = [], [], [], [], []
        waiting = [(0, len(ids), None)]
        while waiting:
            a, b, parent = waiting.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.first)
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            lows.append(low)
            highs.append(high)
            if parent is not None:
                self.children[parent].append(node)
            if b - a > leaf and points.shape[1] and (high > low).any():
                axis = int(np.argmax(high - low))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half, kind="introselect")]
                waiting += [(a, a + half, node), (a + half, b, node)]
        self.low, self.high = np.array(lows, float), np.array(highs, float)
        self.ids, self.points = ids[order], points[order].astype(float)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row of the node scores above this. Exact, as all terms are integers."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """At most k (score, id), best first; rows that score below ``least`` may be left out."""
        scores, ids = np.empty(0), np.empty(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.first[node], self.last[node]
            found = self.points[a:b] @ query
            hit = (found >= least) & (self.ids[a:b] != own)
            scores, ids = np.append(scores, found[hit]), np.append(ids, self.ids[a:b][hit])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                least = max(least, scores[-1])
        return list(zip(scores.astype(np.int64).tolist(), ids.tolist()))


def quantised(rows: DataFrame, scale: int, id_name: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    # Taken as double before scaling; the product is exact for a power of two.
    v = F.transform(x.cast("array<double>"), lambda e: F.floor(e * F.lit(float(scale))))
    big = F.exists(F.col("v"), lambda e: F.abs(e) > LARGEST)
    return (rows.where(F.col(id_name).isNotNull() & usable)
            .select(F.col(id_name).cast("bigint").alias("vec_id"), v.alias("v"))
            .withColumn("v", F.when(big, F.raise_error(F.lit("a component is too large"))).otherwise(F.col("v"))))


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(size, -1)


def _answers(tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    for at in range(0, len(ids), QUERY_BLOCK):
        block = queries[at: at + QUERY_BLOCK].astype(float)
        for own, query, bounds, floor in zip(ids[at: at + QUERY_BLOCK].tolist(), block, tree.bounds(block),
                                             least[at: at + QUERY_BLOCK]):
            out += [(own, i, s) for s, i in tree.search(own, query, bounds, k, floor)]
    names = ("query_id", "vec_id", "score")
    return pa.table({n: pa.array([row[i] for row in out], pa.int64()) for i, n in enumerate(names)})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps at most k a query and task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, wanted: Column, k: int = 5, scale: int = 256, id_name: str = "vec_id",
          vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``wanted`` holds for, its k best others.

    ``wanted`` is a condition on a column vec_id.
    """
    points = written(quantised(rows, scale, id_name, vector)
                     .withColumn("row", F.xxhash64(F.monotonically_increasing_id())))
    shards = max(1, round(points.count() / shard_rows))
    dealt = points.withColumn("size", F.size("v")).withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))
    asked = written(dealt.where(wanted).groupBy(F.col("vec_id").alias("query_id"))
                    .agg(F.min(F.struct("v", "row", "size", "shard")).alias("m"))
                    .select("query_id", F.col("m.v").alias("q"), "m.row", "m.size", F.col("m.shard").alias("home")))
    blocks = max(1, round(asked.count() / QUERY_ROWS))
    marked = dealt.join(asked.select("row", F.lit(True).alias("asks")), "row", "left")

    def own_shard(key, shard):
        ids, vs = shard.column("vec_id").to_numpy(), _matrix(shard.column("v"), shard.num_rows)
        mine = shard.column("asks").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        return _answers(Tree(ids, vs), ids[mine], vs[mine], np.full(int(mine.sum()), -np.inf), k)

    near = written(marked.groupBy("size", "shard").applyInArrow(own_shard, _FOUND))
    floor = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # A k-th score is known only where the own shard had k rows to offer.
    asked = asked.join(floor, "query_id", "left").withColumn(
        "least", F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))).drop("n")
    # Each block of queries meets each shard in a task of its own; neither side of a task grows with the data.
    others = (asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
              .where(F.col("shard") != F.col("home")).select("query_id", "q", "least", "size", "shard", "block"))
    shards_for_blocks = (dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                         .select("vec_id", "v", "size", "shard", "block"))

    def other_shard(key, queries, shard):
        if not queries.num_rows or not shard.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        tree = Tree(shard.column("vec_id").to_numpy(), _matrix(shard.column("v"), shard.num_rows))
        return _answers(tree, queries.column("query_id").to_numpy(), _matrix(queries.column("q"), queries.num_rows),
                        queries.column("least").to_numpy(), k)

    far = (others.groupBy("size", "shard", "block").cogroup(shards_for_blocks.groupBy("size", "shard", "block"))
           .applyInArrow(other_shard, _FOUND))
    return _best(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
