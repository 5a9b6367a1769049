"""Inputs beyond the sizes and shapes that earlier limits allowed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contract.operator_queries import QUERIES
from recon.functions import text
from recon.operators import grading, lineage, reconcile, transcripts
from recon.sources.store import store_for


def test_closure_of_a_long_chain_and_of_many_paths(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(40)], "field string, depends_on string")
    found = lineage.lineage_closure(chain, spark.createDataFrame([("c0",)], "field string"))
    assert {(r.field, r.depth) for r in found.collect()} == {(f"c{i}", i) for i in range(1, 41)}
    diamonds = [(f"{s}{i}", f"{t}{i + 1}") for i in range(21) for s in "ab" for t in "ab"] + [("a21", "a0")]
    found = lineage.lineage_closure(spark.createDataFrame(diamonds, "field string, depends_on string"),
                                    spark.createDataFrame([("a0",)], "field string"))
    assert found.count() == 2 * 21 + 1


def test_a_log_longer_than_the_budget(spark):
    rows = [(1, t, "note" if t % 3 else "sql", False, None, None, None) for t in range(1, 61)]
    columns = "ep long, turn int, action string, valid_sql boolean, correct boolean, reward double, success boolean"
    r = transcripts.score_transcripts(spark.createDataFrame(rows, columns), "ep").first()
    assert (r.n_logged, r.n_unknown, r.ended_at) == (60, 40, 24)


def test_every_field_of_a_row_is_rendered(spark):
    row = spark.range(1).select(*[F.lit(i).alias(f"f{i}") for i in range(30)])
    assert row.select(text.row_text([(c, F.col(c)) for c in row.columns]).alias("t")).first().t.count("=") == 30


def test_composite_keys_stay_apart(spark):
    rows = [(1, None), (2, None), (None, None), (None, 1)]
    frame = spark.createDataFrame(rows, "a int, b int")
    assert len({r.k for r in frame.select(text.key_text(["a", "b"]).alias("k")).collect()} - {None}) == 4
    colons = spark.createDataFrame([("x:y", "z"), ("x", "y:z"), ("x\\", "y:z")], "a string, b string")
    assert colons.select(text.key_text(["a", "b"]).alias("k")).distinct().count() == 3


@pytest.mark.parametrize("a, b, wanted", [
    ("double", "decimal(10,2)", "double"), ("int", "bigint", "bigint"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"),
    ("int", "decimal(10,2)", "decimal(38,2)"), ("date", "timestamp", "timestamp"), ("string", "int", "string"), ("float", "int", "double"),
])
def test_common_type(a, b, wanted):
    assert reconcile.common_type(a, b) == wanted


def test_first_column_by_position_and_failures_alone(spark, tmp_path):
    sandbox = grading.Sandbox(spark)
    sandbox.register({"t": sandbox.session.range(3).withColumnRenamed("id", "k")})
    twice = sandbox.run("SELECT a.k, b.k FROM t a LEFT JOIN t b ON a.k = b.k")
    assert sorted(r.pk for r in twice.collect()) == ["0", "1", "2"]
    texts = ["SELECT k FROM t", "SELECT k FROM t WHERE k = (SELECT k FROM t)", "SELECT nothing FROM t", "SELECT k FROM t WHERE k > 1"]
    plans, outcome = grading.run_candidates(
        spark, sandbox, "trap", [grading.Candidate("d", str(i), s) for i, s in enumerate(texts)])
    assert [p is None for p in plans] == [False, False, True, False] and outcome[2][3]
    number = iter(range(100))

    def write(frames):
        path = str(tmp_path / str(next(number)))
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        whole.write.parquet(path)
        return spark.read.parquet(path)

    spark = sandbox.session
    hits, errors = grading.executed([(i, p) for i, p in enumerate(plans) if p is not None], write)
    assert list(errors) == [1] and sum(h.count() for h in hits) == 4


def test_schemas_are_compared_without_writing_reports(spark, folder, tmp_path):
    link = tmp_path / "tables"
    link.symlink_to(folder)
    found = QUERIES["schema_diff"](spark, str(link)).collect()
    assert {(r.defect_id, r.change) for r in found} >= {("NW01", "missing")} and all(r.n_rows > 0 for r in found)
    assert not [n for n in store_for(spark, str(link)).names() if n.startswith(("trap_", "clean_", "wide_", "by_"))]
