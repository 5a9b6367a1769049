"""Loaders, catalogue and the registry of queries."""

from __future__ import annotations

import json
import re

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import entry, oracle_sql, queries
from contract import operator_queries
from recon.functions.exact import month_shift
from recon.plans.episodes import episodes, read_jsonl, schema_text, write_jsonl
from recon.plans.workbench import Workbench
from recon.sources import catalog, loaders
from recon.sources.tables import SourceTables
from tests.compare import compare, open_duckdb

TYPE = T.StructType().add("id", "integer").add("name", "string").add("n", "double")


def test_csv_refuses_wrong_field_counts(spark, tmp_path):
    path = tmp_path / "in.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write('1,a,1.5\n2,b\n3,"c,c",2\n4,d,3,extra\nx,e,1\n')
    loaded = loaders.load_csv_checked(spark, str(path), TYPE)
    assert sorted(r.id for r in loaded.rows.collect()) == [1, 3]
    assert loaded.rows.count() == 2
    assert sorted(r[loaders.BAD_ROW] for r in loaded.dropped.collect()) == ["2,b", "4,d,3,extra", "x,e,1"]
    kept = loaders.load_csv_checked(spark, str(path), TYPE, row_filter=F.col("n") > 1.7)
    assert [r.id for r in kept.rows.collect()] == [3]


def test_tsv_pads_cuts_and_nulls(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text("1\ta\t2\n\n  \n2\tb\n3\t\\N\t4\textra\n007\t\tx\n")
    got = sorted(tuple(r) for r in loaders.load_tsv_padded(spark, str(path), TYPE).collect())
    assert got == [(1, "a", 2.0), (2, "b", None), (3, None, 4.0), (7, None, None)]


def test_catalogue_hides_internal_tables(spark):
    frames = {"zz_truth": spark.range(1), "b": spark.range(1), "a": spark.range(1).withColumn("x", F.lit("t"))}
    rows = [tuple(r) for r in catalog.catalog_frame(spark, frames).orderBy("table_name", "position").collect()]
    assert rows == [("a", 1, "id", "bigint"), ("a", 2, "x", "string"), ("b", 1, "id", "bigint")]
    assert schema_text(frames, limit=1).splitlines()[1:] == ["  a  (id, ...)", "  b  (id)"]
    assert schema_text(frames).splitlines()[1:] == ["  a  (id, x)", "  b  (id)"]
    gate = catalog.integrity_gate(catalog.table_inventory({"a": spark.range(0), "b": spark.range(0)})).collect()[0]
    assert (gate.n_tables, gate.total_rows, gate.usable) == (2, 0, False)


@pytest.mark.parametrize("month,by,wanted", [(202412, 1, 202501), (202401, -1, 202312), (202406, -30, 202112)])
def test_month_shift(spark, month, by, wanted):
    assert spark.range(1).select(month_shift(F.lit(month), by).alias("m")).collect()[0].m == wanted


def test_every_query_has_sql():
    # The numbered corpus operators and their pipeline are tested by brute force where SQL cannot say them.
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own == {name for name in oracle_sql() if name in own} and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 1251


LIGHT = (
    "part_margin", "diff_ZT02", "gold_SK03", "load_csv_checked", "load_tsv_nulls", "tolerance_predicate",
    "fanout_profile", "screen_candidates", "query_references", "score_transcripts", "risk_columns",
    "lineage_closure", "month_shift", "key_extraction", "episodes", "split_stats", "planted_drift",
    "parse_responses", "extraction_requests",
)


@pytest.mark.parametrize("name", LIGHT)
def test_query_agrees_with_sql(spark, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert compare(got, open_duckdb(folder).execute(oracle_sql()[name]).df()) == ""


def test_every_table_is_copied_whole(spark, folder):
    got = {r.table_name: r for r in queries()["typed_copy_tables"](spark, folder).collect()}
    sources = SourceTables(spark, folder)
    assert set(got) == set(sources)
    copies = operator_queries._typed_copies(Workbench(spark, folder))
    for name, frame in sources.items():
        assert got[name].n_rows == frame.count() and got[name].n_columns == len(frame.columns)
        assert copies[name].exceptAll(loaders.typed_copy(frame)).isEmpty() and copies[name].columns == frame.columns


@pytest.mark.parametrize("name", ("typed_copy", "typed_copy_tables"))
def test_copies_agree_with_sql(spark, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert compare(got, open_duckdb(folder).execute(oracle_sql()[name]).df()) == ""


def test_episodes_carry_their_evidence(spark, folder, tmp_path):
    bench = Workbench(spark, folder)
    table = episodes(bench)
    rows = table.collect()
    assert rows
    scores = {(r.defect_id, r.seed): r for r in bench.walk_scores().filter("variant = 'gold'").collect()}
    for r in rows:
        assert [s.position for s in r.walk] == list(range(len(r.walk))) and r.walk[0].evidence_pk == r.suspect_pk
        assert r.gold.walkthrough.steps == r.walk and r.gold.hypotheses == r.hypotheses
        assert r.hypotheses[0].columns == r.gold.root_cause.columns[:1]
        assert r.verdict.walkthrough.n_steps == scores[r.defect_id, r.seed].n_steps == len(r.walk)
        assert r.verdict.response.success and r.verdict.walkthrough.score == 1.0
        assert json.loads(r.assistant)["walkthrough"]["steps"][0]["evidence"] == r.walk[0].evidence
    write_jsonl(table, str(tmp_path / "out"))
    assert sorted(read_jsonl(bench, str(tmp_path / "out"), table).collect(), key=lambda r: r.episode_id) == sorted(rows, key=lambda r: r.episode_id)
