"""What keeps the driver small: few buckets, jobs of bounded size, no large side sent through it."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recon.operators import grading, sampling
from recon.operators.reconcile import diff_many
from recon.plans import runs
from recon.sources.store import ASKED_BUCKETS, TableStore


def test_many_shuffle_partitions_ask_for_bounded_buckets(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = {}
        for asked in (3, 600):
            spark.conf.set("spark.sql.shuffle.partitions", asked)
            store = TableStore(spark)
            store.size_buckets(spark.range(10))
            got[asked] = store.buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == {3: 3, 600: ASKED_BUCKETS}


def test_large_tables_are_written_by_few_jobs_at_a_time(spark):
    store = TableStore(spark)
    most = store.workers()._max_workers
    store.buckets = 4 * spark.sparkContext.defaultParallelism + 1
    assert store.workers()._max_workers < most <= 4


def test_parts_are_one_table_written_apart(spark):
    store = TableStore(spark)
    built = []

    def part(name, n):
        built.append(name)
        return spark.range(n).select(F.lit(name).alias("part"), F.when(F.col("id") > 0, F.col("id")).alias("id"))

    builds = {name: lambda name=name, n=n: part(name, n) for name, n in (("a", 3), ("b", 0), ("c", 2))}
    want = [("a", None), ("a", 1), ("a", 2), ("c", None), ("c", 1)]
    for _ in range(2):
        assert sorted(map(tuple, store.parts("apart", builds).collect()), key=str) == sorted(want, key=str)
    assert sorted(built) == ["a", "b", "c"]
    assert {p.split("/")[-2] for p in store.parts("apart", builds).inputFiles()} >= {"a", "c"}
    with pytest.raises(ValueError, match="different columns"):
        store.parts("unlike", {"a": lambda: spark.range(1), "b": lambda: spark.range(1).withColumnRenamed("id", "x")})


def test_a_job_has_few_runs(spark, tmp_path, monkeypatch):
    spark.range(50).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "t"))
    box = grading.Sandbox(spark)
    box.register({"t": box.session.read.parquet(str(tmp_path / "t"))})
    jobs, run = [], grading.executed

    def counted(plans, write):
        jobs.append(len(plans))
        return run(plans, write)

    monkeypatch.setattr(grading, "executed", counted)
    texts = [("d", f"SELECT x FROM t WHERE x < {i}") for i in range(20)] + [("d", "SELECT raise_error('broken') FROM t")]
    frame = runs.named_texts(spark.createDataFrame(texts, "defect_id string, diagnostic_sql string"), "diagnostic_sql")
    bench = SimpleNamespace(spark=spark, store=TableStore(spark))
    ran = runs.PlanRuns(bench, lambda side, defect_id: box, "few", ("trap",)).execute(frame, grading.row_count, "n_rows bigint, n_chars bigint")
    assert sum(n for n in jobs if n >= runs.JOB_RUNS) >= 16 and max(jobs) <= runs.JOB_RUNS
    counts = ran.results("defect_id string, candidate string, side string, n_rows bigint, n_chars bigint")
    assert sorted(r.n_rows for r in counts.collect()) == list(range(20))
    assert ran.outcomes().where("error <> ''").count() == 1 and ran.outcomes().count() == 21


def test_null_keys_are_sought_in_the_plain_layout(spark, tmp_path):
    rows = [(1, 1, 5), (1, None, 6), (None, None, 7), (None, None, 8), (2, 2, None), (2, 2, 9)]
    other = [(1, 1, 5), (1, None, 4), (None, None, 7), (3, None, 1)]
    pair, plain = [], []
    for name, own in (("r", rows), ("e", other)):
        entry = f"plain_{tmp_path.name}_{name}".lower()
        spark.createDataFrame(own, "a int, b int, v int").repartition(4, "a", "b").write.bucketBy(4, "a", "b").sortBy("a", "b").option(
            "path", str(tmp_path / name)).saveAsTable(entry)
        pair.append(spark.table(entry))
        plain.append(spark.read.schema(pair[-1].schema).parquet(str(tmp_path / name)))
    pairs = {"x": (*pair, ("a", "b"), "v")}
    got = diff_many(pairs, "name", "decimal(38,4)", {"x": tuple(plain)})
    want = diff_many(pairs, "name", "decimal(38,4)")
    bucketed = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Bucketed: true")
    assert bucketed(got) == 2 < bucketed(want)  # before they run
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.flagged_pk for r in got.collect()} == {"1:\\N", "\\N:\\N", "2:2", "3:\\N"}


def test_numbering_sends_no_blocks_through_the_driver(spark):
    keys = spark.range(9_000).select(F.concat(F.lit("c"), F.col("id") % 2).alias("class"), F.lit(7).cast("long").alias("seed"), F.col("id").cast("string").alias("key"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        numbered = sampling.numbered(keys, "class", "seed", "key")
        assert "Broadcast" not in numbered._jdf.queryExecution().executedPlan().toString()
        got = numbered.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("a"), F.max("number").alias("z")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {(r.n, r.d, r.a, r.z) for r in got} == {(4_500, 4_500, 0, 4_499)}
