"""Prefix trie, whitening and winnowing against plain Python, numpy and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from recon.llm import decontamination, prefix_trie, whitening
from tests.compare import compare, open_duckdb


@pytest.mark.parametrize("name", ("op11_prefix_trie", "op13_winnowing"))
@pytest.mark.parametrize("folder", ("/root/testdata/sf0.001", "/root/testdata/sf0.01"))
def test_query_agrees_with_sql(spark, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert compare(got, open_duckdb(folder).execute(oracle_sql()[name]).df()) == ""


# prefix trie

TURN = "conv_id long, turn long, role string, text string, a long, pos string, words string"


def rebuilt_by_hand(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + ts[h:])
    return out


def trie_by_hand(convs):
    members, below = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        kids, n = below.get(node, []), len(members[node])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        own = (n - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = own + sum(saved[k] for k in kids)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(kids), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def some_turns():
    pick = random.Random(3)
    turns = []
    for c in range(-45, 130):
        for t in range(pick.choice([0, 1, 1, 2, 3, 5, 7])):
            turns.append((c, t if t or c % 3 else None, pick.choice(["u", "a", None]), pick.choice(["", "x y", "hello  there", None, "z"])))
    turns += [(200, i, "u", f"t {i % 5}") for i in range(3000)] + [(201, i, "u", f"t {i % 5}") for i in range(2500)]
    turns += [(None, 1, "a", "b")] + [(300, 1, "u", "same")] * 3 + [(301, 0, "u", "long " * 50_000)]
    return turns + [t for c in range(400, 700) for t in ((c, 0, "u", "hi all"), (c, 1, "a", "copy of it"))]


def turn_frame(spark, turns):
    return spark.createDataFrame([(*t, 1, "clash", "clash") for t in turns], TURN)


def trie_rows(tables, **more):
    return sorted((tuple(r) for r in prefix_trie.trie(tables, **more).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("block,slots,chunk", ((1024, 1 << 27, 1 << 16), (50, 1 << 8, 20)))
def test_trie_by_hand(spark, monkeypatch, block, slots, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "_CHUNK", chunk)
    turns = some_turns()
    got = trie_rows(prefix_trie.rebuilt(turn_frame(spark, turns)), most_slots=slots)
    assert got == trie_by_hand(rebuilt_by_hand(turns))


def test_trie_of_plain_conversations(spark):
    turns = [(1, 0, "u", "a b"), (1, 1, "a", "c"), (2, 0, "u", "a b"), (3, 0, "u", "d"), (4, None, None, None)]
    got = trie_rows(prefix_trie.plain(turn_frame(spark, turns)))
    convs = {1: (("u", "a b"), ("a", "c")), 2: (("u", "a b"),), 3: (("u", "d"),), 4: (("", ""),)}
    assert got == trie_by_hand(convs)
    assert [r[6] for r in got if r[1] == 0] == [2]


def test_trie_of_nothing(spark):
    assert trie_rows(prefix_trie.rebuilt(turn_frame(spark, []))) == []
    assert trie_rows(prefix_trie.rebuilt(turn_frame(spark, [(None, 1, "u", "x")]))) == []


def test_single_prefixes_stay_local(spark):
    turns = [(c, t, "u", f"own {c} {t}") for c in range(1, 400) for t in range(5)]
    rows = prefix_trie.prefixes(*prefix_trie.plain(turn_frame(spark, turns)))
    seen = prefix_trie.screened(rows, prefix_trie.Sketch(rows))
    assert seen.where("shared").count() < 10


# whitening

VECTOR = "vec_id long, embedding array<float>, label int, x string, component int, n long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 7, 7) for i, v in rows], VECTOR)


def whitened_by_numpy(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    d = (n * x - s) / n
    values, basis = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)[:k]
    return ((n * x - s) ** 2).sum(axis=1), d @ (basis[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def test_whitening_by_numpy(spark):
    pick = np.random.default_rng(5)
    good = (pick.standard_normal((700, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 39 + [None]), (1003, [1.0] * 39 + [float("nan")]),
           (1004, [float("inf")] + [1.0] * 39), (1005, [1.0] * 12), (1006, [1e30] * 40)]
    rows += [(None, good[0].tolist()), (3, good[3].tolist())]
    got = whitening.whiten(vector_frame(spark, rows + odd)).toPandas()
    deviation, white, explained = whitened_by_numpy([v for _, v in rows])
    assert len(got) == len(rows) * 32 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert (got.n == len(rows)).all() and got.vec_id.isna().sum() == 32
    assert (got.vec_id == 3).sum() == 64
    got = got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    ids = got.vec_id.to_numpy(np.int64).reshape(-1, 32)[:, 0]
    found = got.whitened.to_numpy().reshape(-1, 32)
    sign = np.sign(found[0] * white[ids[0]])
    assert np.allclose(found * sign, white[ids], atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:32], explained, rtol=1e-9)
    assert (got.deviation.to_numpy()[::32] == deviation[ids]).all()
    assert (got.deviation.astype(str) == got.deviation_text).all()


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitening.whiten(vector_frame(spark, [])).count() == 0
    assert whitening.whiten(vector_frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vector_frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    line = whitening.whiten(vector_frame(spark, [(i, [float(i), float(2 * i), 1.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(0, [2.0**55, 0.0]), (1, [-(2.0**55), 1.0]), (2, [0.0, 2.0])]
    got = whitening.whiten(vector_frame(spark, rows)).collect()
    x = [[2**61 + 10**6, 10**6], [-(2**61) + 10**6, 64 + 10**6], [10**6, 128 + 10**6]]
    s = [sum(c) for c in zip(*x)]
    want = {i: str(sum((3 * a - t) ** 2 for a, t in zip(v, s))) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation_text for r in got} == want
    assert {r.deviation for r in got if r.vec_id < 2} == {None}


@pytest.mark.parametrize("kind", ("random", "repeated", "identity", "graded"))
def test_eigenvectors(kind):
    pick = np.random.default_rng(2)
    if kind == "random":
        a = pick.standard_normal((200, 90))
        m = a.T @ a
    elif kind == "repeated":
        m = np.kron(np.eye(6), np.ones((7, 7)))
    elif kind == "identity":
        m = np.eye(50)
    else:
        q = np.linalg.qr(pick.standard_normal((40, 40)))[0]
        m = q @ np.diag(10.0 ** -np.linspace(0, 9, 40)) @ q.T
    values, vectors = whitening.leading_components(m, 32)
    want = np.linalg.eigvalsh(m)[::-1][: len(values)]
    assert np.abs(values - want).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-12 * want[0]


# winnowing

def contaminated_by_hand(docs, items):
    lower = {i: i + 32 for i in range(65, 91)}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    known = {}
    for item, text in items:
        words = cut(text)
        n = min(10, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            known.setdefault(tuple(words[a: a + n]), set()).add(item)
    out = []
    for doc, text in docs:
        words, found = cut(text), set()
        hit = [False] * len(words)
        for n in {len(k) for k in known}:
            for a in range(len(words) - n + 1):
                if tuple(words[a: a + n]) in known:
                    found |= known[tuple(words[a: a + n])]
                    hit[a: a + n] = [True] * n
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast", (decontamination.MOST_BROADCAST, 0))
def test_winnowing_by_hand(spark, edge, edge_rows, most_broadcast):
    texts = [t for _, t in edge_rows if t]
    parts = texts[0].split()
    items = [(1, " ".join(parts[20:45])), (2, " ".join(parts[30:39])), (3, " ".join(parts[70:75]).upper() + "!"), (4, "w3"), (5, None),
             (6, " \n"), (None, " ".join(parts[100:115])), (1, " ".join(texts[10].split()[:12])), (7, " ".join(parts[20:45])),
             (8, "card 4111 1111"), (9, "été 日本語")]
    bench = spark.createDataFrame([(*i, "clash", 0) for i in items], "item_id long, text string, fp string, length int")
    got = decontamination.contamination(edge, bench, most_broadcast).drop("items").collect()
    want = contaminated_by_hand(edge_rows, items)
    assert sorted((tuple(r) for r in got), key=str) == want and any(r[5] for r in want)


@pytest.mark.parametrize("most_broadcast", (decontamination.MOST_BROADCAST, 0))
def test_winnowing_of_nothing(spark, edge, empty, edge_rows, most_broadcast):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(edge, bench, most_broadcast).collect()
    assert len(got) == len(edge_rows) and not any(r.contaminated for r in got)
    some = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert decontamination.contamination(empty, some, most_broadcast).count() == 0


def test_clean_documents_keep_their_columns(spark, edge, edge_rows):
    bench = spark.createDataFrame([(1, edge_rows[0][1])], "item_id long, text string")
    kept = decontamination.clean_documents(edge, bench)
    assert kept.columns == edge.columns
    want = [r for r in contaminated_by_hand(edge_rows, [(1, edge_rows[0][1])]) if not r[5]]
    assert kept.count() == len(want)


def test_every_long_shared_span_is_found():
    """Winnowing's guarantee: whatever stands around it, a window's kept hash is kept."""
    pick = np.random.default_rng(0)
    for _ in range(200):
        span = pick.integers(0, 4, 10).astype(np.uint64)
        text = np.concatenate([pick.integers(0, 4, pick.integers(0, 30)), span, pick.integers(0, 4, pick.integers(0, 30))]).astype(np.uint64)
        kept = decontamination.kept_grams(text, np.array([0, len(text)]), 10)[0]
        assert np.isin(decontamination.kept_grams(span, np.array([0, 10]), 10)[0], kept).all()
