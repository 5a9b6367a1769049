"""Operators that relate rows to each other, and the pipeline, against plain Python."""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recon.llm import jaccard_join, kd_search, kd_sharding, mixing
from recon.llm.common import slices, table
from recon.llm.components import components


# sharding

def test_sharding(edge, empty, edge_rows):
    got = kd_sharding.shard(edge, 4).collect()
    assert len(got) == len(edge_rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for s in {r.shard for r in got}:
        assert 0 <= s < 4 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in edge_rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    assert kd_sharding.shard(empty).count() == 0


def test_shards_are_even_and_groups_together(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = kd_sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(got) == 24 and got.max() < 1.03 * got.mean() and got.min() > 0.97 * got.mean()


def test_a_hot_group_is_dealt_out(spark, tmp_path):
    from tests.llm.conftest import write_docs

    rows = [(i, "same text " * 20 if i % 3 else f"text {i} " * 20) for i in range(3000)]
    got = kd_sharding.shard(spark.read.parquet(write_docs(tmp_path / "d.parquet", rows))).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(got) == 24 and got.max() < 1.15 * got.mean()


# components and Jaccard join

def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (400, 300), (7, 7), (500, 500)] + [(1000, 1000 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 200, 300, 400)} == {100} and got[1049] == 1000
    assert 500 not in got and components(spark.createDataFrame([], "a long, b long")).count() == 0


def groups_by_hand(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc_id, frozenset(tuple(w[k: k + width]) for k in range(len(w) - width + 1)) if len(w) >= width
                     else frozenset([tuple(w)] if w else [])))
    parent = {s: s for _, s in sets}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    named = list({s for i, s in sets if i is not None and s})
    for i, a in enumerate(named):
        for b in named[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[find(a)] = find(b)
    least = {}
    for i, s in sets:
        if i is not None and s:
            least[find(s)] = min(least.get(find(s), i), i)
    return sorted([(i, len(s), i if not s or i is None else least[find(s)]) for i, s in sets], key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_groups(edge, edge_rows, width, percent):
    got = jaccard_join.near_groups(edge, width, percent).collect()
    assert sorted([tuple(r) for r in got], key=lambda r: (r[0] is not None, r)) == groups_by_hand(edge_rows, width, percent)


def test_jaccard_chains_of_near_copies(spark, tmp_path):
    """Clusters whose ends are far apart, and links between clusters that no pivot shows."""
    from tests.llm.conftest import write_docs

    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(25):
            rows.append((g * 100 + i, " ".join(words)))
            words[(i * 7) % 60] = f"g{g}new{i}"
            words = words[:] if i % 5 else words + [f"g{g}more{i}"]
    rows += [(900 + i, rows[i][1] + " tail" * (i % 3)) for i in range(0, 100, 9)]
    docs = spark.read.parquet(write_docs(tmp_path / "d.parquet", rows))
    for percent in (85, 70):
        got = jaccard_join.near_groups(docs, 2, percent).collect()
        assert sorted(tuple(r) for r in got) == groups_by_hand(rows, 2, percent)


def test_jaccard_long_lists_and_quartered_sketches(spark, tmp_path, monkeypatch):
    """Every list is cut into blocks, sketches of sets of over 24 shingles take a share of them: the links stay."""
    from tests.llm.conftest import write_docs

    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 1)
    monkeypatch.setattr(jaccard_join, "SKETCHED", 24)
    words = [f"w{i}" for i in range(130)]
    rows = [(10 * n + k, " ".join([*words[:n], *[f"x{n}y{k}z{j}" for j in range(k)], "tail of all texts"])) for n in (20, 22, 25, 90, 98, 130) for k in range(4)]
    docs = spark.read.parquet(write_docs(tmp_path / "d.parquet", rows))
    got = jaccard_join.near_groups(docs, 2, 85).collect()
    assert sorted(tuple(r) for r in got) == groups_by_hand(rows, 2, 85)


def test_sketches_bound_the_distance_and_tell_large_sets_apart(spark):
    rng, rows = np.random.default_rng(3), []
    for n in (3, 40, 300, 1390, 1410, 3000, 5590, 5610, 30_000):
        for other in (0, n // 50, n // 20, n):  # shingles of one set that the other lacks, in both
            marks = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))]
            marks.append(np.sort(np.concatenate([marks[0][: n - other], rng.integers(0, 2**64, other + n // 99, dtype=np.uint64)])))
            owner = np.repeat([0, 1], [len(m) for m in marks])
            a, b = jaccard_join.sketches(owner, np.concatenate(marks), 2).to_pylist()
            shared = n - other
            rows.append((n, other, 1 - shared / (len(marks[1]) + other), len(marks[0]), a, len(marks[1]), b))
    found = spark.createDataFrame(rows, "n int, other int, far double, a_size int, a_sketch array<bigint>, b_size int, b_sketch array<bigint>").select(
        "n", "other", "far", jaccard_join._least_distance("a", "b").alias("least"), jaccard_join._likely("a", "b", 85).alias("likely")).collect()
    assert all(r.least <= r.far + 1e-9 for r in found)
    level = {n: int(jaccard_join._fourths(np.array([n]))[0]) for n in (1400, 1401, 5600, 5601, 22_401)}
    assert level == {1400: 0, 1401: 1, 5600: 1, 5601: 2, 22_401: 3}
    same = [r for r in found if r.n not in (1390, 5590)]  # their partners lie beyond the limit
    assert all(r.likely for r in same if r.far <= 0.15)
    assert not any(r.likely for r in same if r.other == r.n >= 300)


def test_jaccard_empty_and_kept_rows(edge, empty, edge_rows):
    assert jaccard_join.near_groups(empty).count() == 0 and jaccard_join.keep_first(empty).count() == 0
    kept = jaccard_join.keep_first(edge)
    assert kept.columns == edge.columns
    want = sorted([i for i, _, c in groups_by_hand(edge_rows, 4, 80) if i is None or i == c], key=lambda i: (i is not None, i))
    assert sorted([r.doc_id for r in kept.collect()], key=lambda i: (i is not None, i)) == want


# top-k search

def test_top_k(spark, tmp_path):
    pick = np.random.default_rng(4)
    vectors = [pick.normal(size=6).astype("f4").tolist() for _ in range(700)]
    vectors[100:160] = [vectors[0]] * 60  # ties
    vectors += [None, [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("inf")] * 6, [0.5, 0.5], [0.25, 1.0], []]
    ids = [*range(700), 700, 705, 710, 715, 720, 725, 730]
    pq.write_table(pa.table({"vec_id": pa.array([*ids, None], pa.int64()), "embedding": pa.array([*vectors, [0.0] * 6], pa.list_(pa.float32())),
                             "shard": ["clash"] * (len(ids) + 1), "q": ["clash"] * (len(ids) + 1)}), tmp_path / "e.parquet")
    rows = spark.read.parquet(str(tmp_path / "e.parquet"))
    usable = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in zip(ids, vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i, q in usable.items():
        if i % 5 == 0:
            best = sorted((-int(q @ v), j) for j, v in usable.items() if j != i and len(v) == len(q))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    for shard_rows in (50, 8000):
        got = {tuple(r) for r in kd_search.top_k(rows, F.col("vec_id") % 5 == 0, shard_rows=shard_rows).collect()}
        assert got == want
    assert kd_search.top_k(rows.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_tree_visits_few_leaves():
    pick = np.random.default_rng(0)
    points = np.concatenate([pick.integers(-5, 5, (2000, 2)) + c for c in ((0, 0), (900, 0), (0, 900), (-900, -900))])
    tree = kd_search.Tree(np.arange(len(points)), points, leaf=50)
    assert (np.diff([tree.first, tree.last], axis=0) > 0).all()
    query = np.array([[1.0, 0.0]])
    bounds = tree.bounds(query)[0]
    found = tree.search(-1, query[0], bounds, 5, -np.inf)
    assert [s for s, _ in found] == sorted((points @ query[0]).astype(int).tolist(), reverse=True)[:5]
    assert (bounds >= found[-1][0]).sum() < len(bounds) / 2


# mixing

def test_mixing_meets_targets(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = mixing.mix(docs, labels).toPandas()
    p, t = got[["p_clean", "p_poor", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all() and (abs(got.copies - got.rate) <= 1).all()
    share = (got.rate.to_numpy()[:, None] * t[:, None] * p).sum(axis=0) / t.sum()
    assert np.abs(share - mixing.TARGET).max() < 0.02
    held = {r.doc_id: r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [int(p[i].argmax()) == (2 if held[d].toxic else 0 if held[d].quality else 1) for i, d in enumerate(got.doc_id) if d in held]
    assert np.mean(right) > 0.7


def test_rates_in_python_and_sql_agree(edge, labels, edge_rows):
    got = mixing.mix(edge, labels, least=0.5).collect()
    assert len(got) == len(edge_rows) and all(r.rate >= 0.5 for r in got)
    again = mixing.resample(edge, labels, least=0.5)
    assert again.columns == edge.columns and again.count() == sum(r.copies for r in got)


def test_mixing_edges(edge, empty, labels, edge_rows):
    assert mixing.mix(empty, labels).count() == 0 and mixing.resample(empty, labels).count() == 0
    assert mixing.mix(edge, labels.limit(0)).count() == len(edge_rows)


def test_mixing_misfit_and_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.mix(docs, labels).toPandas()
    p, t = got[["p_clean", "p_poor", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy()
    share = (got.rate.to_numpy()[:, None] * t[:, None] * p).sum(axis=0) / t.sum()
    assert (np.abs(share / mixing.TARGET - 1) < mixing.MISFIT).all()
    held = {r.doc_id: 2 if r.toxic else 0 if r.quality else 1 for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    known = [(int(p[i].argmax()), held[d]) for i, d in enumerate(got.doc_id) if d in held]
    truth = np.array([b for _, b in known])
    assert np.mean([a == b for a, b in known]) > np.bincount(truth).max() / len(truth)


def test_missed_totals_are_reported(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    with pytest.warns(UserWarning, match="mixing misses its totals: clean"):
        mixing.mix(docs, labels, weights=(0.05, 0.90, 0.05), least=1.0)


# pipeline

def test_pipeline_does_not_repeat_what_looks_toxic(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    found = labels.where("toxic = 1 AND doc_id % 10 <> 0").select("doc_id")
    docs = table(spark, folder, "documents").join(found, "doc_id", "left_anti")
    copies = {r.doc_id: r["count"] for r in corpus_pipeline.mixing_stage(spark, docs, folder).groupBy("doc_id").count().collect()}
    seen = mixing.posteriors(docs, mixing.fit_posterior(docs, labels)).collect()
    assert set(copies) == {r.doc_id for r in seen}
    before = sum(r.n_tokens * r.p[2] for r in seen)
    after = sum(r.n_tokens * r.p[2] * copies[r.doc_id] for r in seen)
    assert after / before < 1.1


def test_pipeline_stages(spark, edge, labels, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        counts.append(docs.count())
        if name != "packing":
            assert sorted(docs.columns) == sorted(edge.columns)
    assert counts[0] >= counts[1] == counts[2] <= counts[3] <= counts[4]
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, folder).count() >= 150


def test_mixing_scores_in_steps_of_a_megabyte(spark, monkeypatch):
    def watched(batches, *limit):
        for part in slices(batches, *limit):
            assert part.column("text").nbytes < 5 << 18
            yield part

    monkeypatch.setattr(mixing, "slices", watched)
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word mark! "), 1500).alias("text"))
    got = mixing.posteriors(docs, mixing.Posterior(np.ones((3, 1 << mixing.BITS)), np.ones(3))).collect()
    assert len(got) == 300 and {r.n_tokens for r in got} == {3000}
