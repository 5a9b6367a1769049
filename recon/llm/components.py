"""Connected components of an edge list, by local contraction and alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import release, written

_ROUNDS = 60
#: Edges a task contracts at a time.
STEP_EDGES = 500_000


def _stars(hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """(node, least node it is connected to by these edges), for all nodes but the least."""
    nodes, place = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    x, y = place[: len(hi)], place[len(hi):]
    label = np.arange(len(nodes))
    while True:
        one, other = label[x], label[y]
        if (one == other).all():
            break
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label[label] != label).any():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], names=["hi", "lo"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect what ``edges`` connect, fewer of them and shorter ways: each task turns its own into stars."""

    def contract(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("hi").to_numpy(), batch.column("lo").to_numpy()))
            size += batch.num_rows
            if size >= STEP_EDGES:
                yield _stars(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield _stars(*(np.concatenate(c) for c in zip(*held)))
        release()

    return edges.select("hi", "lo").mapInArrow(contract, "hi bigint, lo bigint").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars about least nodes: no node is both leaf and centre, or leaf of two."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("lo").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    roles = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return not roles.where("leaf > 1 OR (leaf > 0 AND centre > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge (a, b); the label is the component's least node.

    Each round contracts edges within tasks, then links every node to the least of its neighbours and of itself,
    first its larger, then its smaller neighbours, until the edges are stars about the least nodes. Minima are
    combined before they are shuffled, so a node of very many edges is one group of few rows.
    """
    now = written(_contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))))
    for _ in range(_ROUNDS):
        if _settled(now):
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(small_least, "hi").select("hi", "lo", "m"))
        now = written(_contracted(small.select(F.col("hi"), F.col("m").alias("lo")).unionByName(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
