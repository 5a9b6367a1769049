"""Parsing, localisation, rewards, selection, transcripts and layer walks on small inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from recon.functions import lexer
from recon.operators import grading, lineage, sampling, scoring, screening, transcripts
from recon.plans.risk import FIELD_DEPENDENCIES


def test_parse_responses(spark):
    cause = {"table": "T", "columns": ["a", "b"]}
    texts = [
        "noise " + json.dumps({"diagnostic_sql": "SELECT 1", "root_cause": cause}) + " tail",
        json.dumps({"diagnostic_sql": "SELECT 2", "root_cause": json.dumps(cause)}),
        "no object", "{broken", None,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")
    got = {r.id: (r.readable, r.diagnostic_sql, r.claimed_table, r.claimed_columns)
           for r in grading.parse_responses(frame).collect()}
    assert got[0] == (True, "SELECT 1", "T", ["a", "b"])
    assert got[1] == (True, "SELECT 2", "T", ["a", "b"])
    assert all(got[i] == (False, None, None, None) for i in (2, 3, 4))


def test_localisation_ignores_case_and_needs_the_primary_column(spark):
    rows = [(1, " Report ", ["A", "z"]), (2, "report", ["b"]), (3, "other", ["a"]), (4, None, None)]
    frame = spark.createDataFrame(rows, "id int, claimed_table string, claimed_columns array<string>").withColumns(
        {"final_table": F.lit("report"), "defect_columns": F.array(F.lit("a"), F.lit("B"))}
    )
    got = {r.id: (r.table_ok, r.columns_ok, r.primary_ok, r.loc) for r in grading.grade_localization(frame).collect()}
    assert got == {
        1: (True, True, True, True), 2: (True, True, False, False),
        3: (False, True, True, False), 4: (False, False, False, False),
    }


def test_screening(spark):
    texts = ["SELECT 1", " with t as (select 1) select * from t ; ", "", " ", "DELETE FROM t", "SELECT 1; SELECT 2",
             "select zz_top", "SELECTED", "select ';' -- ; zz_a", "/* zz_ */ Select 'it''s; zz_b' ; ;", "-- only this", "select `zz_c`",
             "select 'open ; zz_d", "select 1 /* open ; "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, sql string")
    got = {r.id: r.error for r in screening.screen_candidates(frame).collect()}
    assert got == {0: "", 1: "", 2: screening.EMPTY, 3: screening.EMPTY, 4: screening.NOT_READ, 5: screening.SEVERAL,
                   6: screening.TRUTH, 7: screening.NOT_READ, 8: "", 9: "", 10: screening.EMPTY, 11: screening.TRUTH, 12: "", 13: ""}


def test_tokens(spark):
    texts = ["SELECT a.b, 'it''s' || \"N\"\"m\" FROM t -- end", "x=1.5e3 /* c\n */>=.7;`q`", "'a\\'b' 'open", "", None, "été_1 <> 'é'\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, sql string")
    got = {r.id: r.t for r in frame.select("id", lexer.tokens(F.col("sql")).alias("t")).collect()}
    for i, sql in enumerate(texts):
        assert "".join(t.token for t in got[i]) == (sql or "")
        assert all(sql[t.position - 1: t.position - 1 + len(t.token)] == t.token for t in got[i])
    shown = lambda i: [(t.kind, t.token) for t in got[i] if t.kind != "blank"]
    assert shown(0) == [("word", "SELECT"), ("word", "a"), ("mark", "."), ("word", "b"), ("mark", ","), ("string", "'it''s'"), ("mark", "|"),
                        ("mark", "|"), ("name", '"N""m"'), ("word", "FROM"), ("word", "t"), ("comment", "-- end")]
    assert shown(1) == [("word", "x"), ("mark", "="), ("number", "1.5e3"), ("comment", "/* c\n */"), ("mark", ">"), ("mark", "="),
                        ("number", ".7"), ("mark", ";"), ("name", "`q`")]
    assert shown(2) == [("string", "'a\\'b'"), ("string", "'open")] and shown(5)[0] == ("word", "été_1")


def test_long_tokens(spark):
    sql = "select '" + "it''s " * 50_000 + "' /*" + " x" * 50_000 + "*/ from t"
    frame = spark.createDataFrame([(sql,)], "sql string")
    row = screening.query_references(screening.screen_candidates(frame).withColumn("s", F.array()), "s").collect()[0]
    assert row.allowed and row.tables_mentioned == ["t"] and row.columns_mentioned == ["t"]


def test_statement(spark):
    texts = [" -- c\n select 1 ; ; -- d\n ", "select ';'", " ; ", "", None, "select 1; select 2;"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, sql string")
    got = {r.id: r.s for r in frame.select("id", screening.statement(F.col("sql")).alias("s")).collect()}
    assert got == {0: "select 1", 1: "select ';'", 2: "", 3: "", 4: "", 5: "select 1; select 2"}


def test_sandbox_only_reads_and_tolerates_arithmetic_faults(spark):
    sandbox = grading.Sandbox(spark)
    sandbox.register({"t": sandbox.session.createDataFrame([(0,), (2,)], "a int")})
    assert sorted(str(r.pk) for r in sandbox.run("SELECT 4 / a FROM t").collect()) == ["2.0", "None"]
    for bad in ("SELECT missing FROM t", "WITH x AS (SELECT 1) INSERT INTO t SELECT 1", "SELECT FROM FROM"):
        _, outcome = grading.run_candidates(spark, sandbox, "trap", [grading.Candidate("d", "c", bad)])
        assert outcome[0][3] != ""


def test_reward_table(spark):
    rows = [
        ("gold", "S", "t", ["a"], True, True, False, True, 0, 1.0),
        ("bonus is capped", "S", "t", ["a"], True, False, True, True, 9, 0.62),
        ("broad", "S", "t", ["a"], True, True, True, True, 0, 0.8),
        ("no query", " ", "t", ["a"], False, False, False, True, 0, 0.2),
        ("nothing", None, None, None, False, False, False, False, 0, 0.0),
        ("one hypothesis", "S", None, ["a"], True, True, False, False, 1, 0.65),
        ("clamped", "S", "t", ["a"], True, True, False, True, 2, 1.0),
    ]
    frame = spark.createDataFrame(
        rows, "id string, diagnostic_sql string, claimed_table string, claimed_columns array<string>, valid boolean, "
        "catch boolean, fp boolean, loc boolean, n int, expected double")
    for r in scoring.reward(frame, "n").collect():
        assert r.reward == pytest.approx(r.expected), r.id


def test_best_of_n_prefers_success_then_the_first(spark):
    rows = [("e", 0, False, True, True, True, 0.9), ("e", 1, True, True, True, True, 0.1), ("e", 2, True, True, True, True, 0.1),
            ("f", 0, False, False, False, True, 0.2), ("f", 1, False, False, False, True, 0.7)]
    frame = spark.createDataFrame(
        rows, "ep string, attempt int, success boolean, precise boolean, catch boolean, valid boolean, walkthrough double")
    best = scoring.best_of_n(frame, ["ep"], "attempt", ["success"])
    assert {r.ep: (r.attempt, r.n_attempts) for r in best.collect()} == {"e": (1, 3), "f": (1, 2)}


def brute_force(turns, max_queries, max_turns):
    """One episode, action by action."""
    queries = correct = 0
    for t in turns:
        if t["action"] == "localize":
            return queries, t["turn"], correct, t["reward"], t["success"], None
        if t["action"] == "sql":
            queries += bool(t["valid_sql"])
        elif t["action"] == "hypothesis":
            correct += bool(t["correct"])
        else:
            continue
        if queries >= max_queries:
            return queries, t["turn"], correct, None, False, transcripts.QUERIES_SPENT
        if t["turn"] >= max_turns:
            return queries, t["turn"], correct, None, False, transcripts.TURNS_SPENT
    return queries, None, correct, None, False, None


def test_transcripts_against_brute_force(spark):
    rng = random.Random(5)
    logs = {}
    for episode in range(60):
        actions = rng.choices(["sql", "hypothesis", "localize", "shrug"], [6, 3, 0.2, 4], k=rng.randint(1, 60))
        logs[episode] = [
            dict(ep=episode, turn=i, action=a, valid_sql=rng.random() < 0.8, correct=rng.random() < 0.3,
                 reward=0.8, success=rng.random() < 0.5)
            for i, a in enumerate(actions, start=1)
        ]
    frame = spark.createDataFrame(
        [t for log in logs.values() for t in log],
        "ep int, turn int, action string, valid_sql boolean, correct boolean, reward double, success boolean")
    got = {r.ep: r for r in transcripts.score_transcripts(frame, "ep").collect()}
    for episode, log in logs.items():
        queries, ended, correct, terminal, success, reason = brute_force(log, 12, 24)
        r = got[episode]
        if any(t["action"] != "shrug" for t in log):
            assert (r.queries, r.ended_at, r.n_correct, r.reason) == (queries, ended, correct, reason), episode
        assert r.terminal_reward == terminal and r.success == success
        assert r.total_reward == pytest.approx((terminal or 0) + 0.05 * correct)


def test_closure_of_the_loss_field(spark):
    graph = lineage.edges(spark, FIELD_DEPENDENCIES)
    found = lineage.lineage_closure(graph, spark.createDataFrame([("ECL",)], "field string"))
    depths = {r.field: r.depth for r in found.collect()}
    assert len(depths) == 15 and depths["EAD_TOTAL"] == 1 and depths["OR_DISBLE"] == 3


def test_split_has_at_least_one_test_episode_per_class(spark):
    rows = [(c, i) for c, n in (("a", 1), ("b", 6), ("c", 10)) for i in range(n)]
    frame = spark.createDataFrame(rows, "c string, i int")
    split = sampling.stratified_split(frame, "c", "i")
    got = {r.c: r["count"] for r in split.filter("split = 'test'").groupBy("c").count().collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_numbers_have_no_gaps_at_any_block_size(spark, monkeypatch):
    sizes = {"a": 1, "b": 2, "c": 700}
    rows = spark.createDataFrame([(c, 7, f"k{i}") for c, n in sizes.items() for i in range(n)] + [("d", 7, None)],
                                 "c string, s long, k string")
    found = []
    for block_rows in (1, 50, 2_000):
        monkeypatch.setattr(sampling, "BLOCK_ROWS", block_rows)
        found.append({(r.c, r.k): r.number for r in sampling.numbered(rows, "c", "s", "k").collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 704
    for c, n in (sizes | {"d": 1}).items():
        assert sorted(v for (d, _), v in found[0].items() if d == c) == list(range(n))


def test_verdicts_from_summaries_of_hits(spark):
    """Repeated and null keys, keys planted for several seeds, a silent run and one that fails on the clean side."""
    hits = [("d", "a", "trap", k) for k in ["p1", "p1", "p2", "x", None]] + [("d", "a", "clean", k) for k in ["p1", None, None]]
    hits += [("d", "b", "trap", "y"), ("e", "a", "trap", "p1"), ("d", "c", "clean", "z")]
    outcomes = [(d, c, s, "BAD" if (c, s) == ("b", "clean") else "") for d, c in (("d", "a"), ("d", "b"), ("d", "c"), ("e", "a")) for s in ("trap", "clean")]
    planted = spark.createDataFrame(
        [("d", 1, 1, "p1"), ("d", 1, 2, "p2"), ("d", 2, 1, "p2"), ("d", 3, 1, "other"), ("e", 1, 1, "p9")],
        "defect_id string, seed long, rank int, flagged_pk string")
    frame = spark.createDataFrame(hits, "defect_id string, candidate string, side string, pk string")
    summary = grading.hit_summary(frame, planted)
    assert {(r.candidate, r.side, r.planted_pk, r.n_keys, r.n_rows) for r in summary.collect() if r.defect_id == "d"} == {
        ("a", "trap", "p1", 1, 2), ("a", "trap", "p2", 1, 1), ("a", "trap", None, 1, 2), ("a", "clean", None, 0, 3),
        ("b", "trap", None, 1, 1), ("c", "clean", None, 0, 1)}
    ran = spark.createDataFrame(outcomes, "defect_id string, candidate string, side string, error string")
    got = {(r.defect_id, r.candidate, r.seed): (r.catch, r.fp, r.n_caught, r.n_clean) for r in grading.grade_summaries(summary, ran, planted).collect()}
    assert got == {
        ("d", "a", 1): (True, True, 3, 3), ("d", "a", 2): (True, True, 3, 3), ("d", "a", 3): (False, True, 3, 3),
        **{("d", "b", s): (False, True, 1, 0) for s in (1, 2, 3)}, **{("d", "c", s): (False, True, 0, 1) for s in (1, 2, 3)},
        ("e", "a", 1): (False, False, 1, 0)}
