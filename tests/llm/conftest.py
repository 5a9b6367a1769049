from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns that carry names the operators use inside.
CLASHING = ("key", "token", "label", "n", "row", "place", "bucket", "score", "found", "body", "p", "shard", "at", "sha", "group")


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, odd white space."""
    pick = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "und", "la"] * 40
    word = lambda k: " ".join(pick.choices(vocabulary, k=k))
    base, passage = word(120), word(30)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "two words"), (8, "one"),
        (9, f"{word(40)}\n{passage} {word(15)}"), (10, f"{word(33)} {passage}"), (11, f"{passage}  {passage}"),
        (12, word(20_000)), (13, "x" * 30_000), (None, base), (None, "lost row"), (14, base), (14, base),
        (15, "mail me: a.b@c.org or +49 (30) 1234-567, card 4111 1111 1111 1111, 10.0.0.255 and 10.0.0.256"),
        (16, "été 日本語 ▁ \x0b\x0c 😀 <s> <|endoftext|> İ ǅ"), (17, base.upper()),
    ]
    return rows + [(18 + i, word(pick.randint(1, 90))) for i in range(30)]


def write_docs(path, rows) -> str:
    n = len(rows)
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
             "lang": pa.array([None if i % 5 == 0 else "en" for i in range(n)], pa.string()),
             "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([None] * n, pa.int64())}
    table |= {c: pa.array(["clash"] * n, pa.string()) for c in CLASHING}
    pq.write_table(pa.table(table), path)
    return str(path)


@pytest.fixture(scope="session")
def edge_rows():
    return edge_texts()


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return spark.read.parquet(write_docs(tmp_path_factory.mktemp("docs") / "edge.parquet", edge_texts()))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return spark.read.parquet(write_docs(tmp_path_factory.mktemp("docs") / "empty.parquet", []))


@pytest.fixture(scope="session")
def labels(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels") / "labels.parquet"
    ids = [0, 1, 2, 2, 3, 4, 6, 9, 10, 12, 20, 21, None, 999]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([i % 2 for i in range(len(ids))], pa.int32()),
                             "toxic": pa.array([None if i == 5 else i % 3 == 0 for i in range(len(ids))], pa.bool_()).cast(pa.int32()),
                             "text": pa.array(["clash"] * len(ids))}), path)
    return spark.read.parquet(str(path))
