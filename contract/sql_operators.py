"""Literal SQL for the operator queries."""

from __future__ import annotations

from contract import sql_reports as r
from recon.plans import episodes
from recon.plans.attempts import KINDS
from recon.plans.defects import DEFECTS
from recon.plans.reports import PIPELINES
from recon.plans.risk import FIELD_DEPENDENCIES, TABLES as RISK_TABLES

SQL: dict[str, str] = {}

MONEY, RATE = "DECIMAL(18,2)", "DECIMAL(4,2)"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# sources ----------------------------------------------------------------------------------

_ORDER_LINE = (
    "CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ',' || o_orderstatus"
)
SQL["load_csv_checked"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderstatus <> 'P'"""
SQL["load_csv_dropped"] = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0
            THEN {_ORDER_LINE} || ',' || CAST(CAST(o_totalprice AS {MONEY}) AS VARCHAR) || ',surplus'
            ELSE {_ORDER_LINE} END AS line
FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0"""
_PART_NAME = """p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'says "so",' ELSE '' END
    || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || chr(10) || 'end' || chr(10) ELSE '' END"""
SQL["csv_multiline"] = f"""
SELECT p_partkey, CASE WHEN p_partkey % 97 <> 0 THEN {_PART_NAME} END AS p_name,
  CASE WHEN p_partkey % 97 <> 0 THEN p_brand END AS p_brand,
  CASE WHEN p_partkey % 97 = 0 THEN CAST(p_partkey AS VARCHAR) || ',"' || replace({_PART_NAME}, '"', '""') || '",' || p_brand || ',surplus'
    END AS refused
FROM part"""
SQL["load_tsv_nulls"] = """
SELECT c_custkey, c_name,
       CASE WHEN c_custkey % 7 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS c_nationkey,
       CASE WHEN c_custkey % 7 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
FROM customer"""
SQL["subset_semi"] = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders
  WHERE (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01') OR o_orderstatus = 'P')"""
SQL["typed_copy"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, value AS amount FROM events"""
SQL["jsonl_roundtrip"] = """
SELECT o_orderkey, o_orderstatus, o_totalprice AS total, replace(o_orderpriority, '-', '|') AS priority
FROM orders"""
_COUNTS = union(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations"))
SQL["table_inventory"] = _COUNTS
SQL["integrity_gate"] = f"""
SELECT COUNT(*) AS n_tables, CAST(SUM(n_rows) AS BIGINT) AS total_rows,
       COUNT(*) >= 2 AND SUM(n_rows) > 0 AS usable FROM ({_COUNTS}) t"""
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
          "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())
_CATALOG = f"""
SELECT DISTINCT c.table_name, CAST(c.ordinal_position AS BIGINT) AS position, c.column_name,
       CASE c.data_type {_CASES} ELSE c.data_type END AS column_type
FROM information_schema.columns c
WHERE c.table_schema = 'main'"""
SQL["schema_catalog"] = f"SELECT k.*, n.n_rows FROM ({_CATALOG}) k JOIN ({_COUNTS}) n USING (table_name)"
SQL["schema_text"] = f"""
SELECT table_name, string_agg(column_name, ', ' ORDER BY position) AS columns_text, MAX(n.n_rows) AS n_rows
FROM ({_CATALOG}) k JOIN ({_COUNTS}) n USING (table_name) GROUP BY table_name"""
SQL["typed_copy_tables"] = f"""
SELECT table_name, COUNT(*) AS n_columns, MAX(n.n_rows) AS n_rows,
  string_agg(column_name || ' ' || replace(column_type, 'timestamp_ntz', 'string'), ', ' ORDER BY position) AS columns_text
FROM ({_CATALOG}) k JOIN ({_COUNTS}) n USING (table_name) GROUP BY table_name"""

# projections and predicates ---------------------------------------------------------------

SQL["staging_projection"] = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice AS order_total FROM orders"""
SQL["line_amount"] = f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(ROUND(CAST(l_extendedprice AS {MONEY}) * CAST(l_quantity AS {MONEY}), 2) AS DOUBLE) AS line_amount
FROM lineitem"""
SQL["null_flag"] = """
SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
       AS nothing_returned FROM orders"""
SQL["open_orders"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'"
SQL["in_filter"] = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')"
SQL["nullsafe_predicate"] = f"""
SELECT o_orderkey, n_returned IS NOT DISTINCT FROM NULLIF(n_lines_calc % 3, 0) AS same,
       n_returned IS DISTINCT FROM NULLIF(n_lines_calc % 3, 0) AS differs
FROM ({r.order_stats()}) t"""
SQL["tolerance_predicate"] = f"""WITH {r.LINES}
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       ABS(net - ROUND(net, 1)) > 0.011 AS beyond_cent, ABS(net - ROUND(net, 1)) > 0.051 AS beyond_tenth
FROM lines"""
SQL["key_lookup"] = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
SQL["like_filter"] = """
SELECT page_id, url, url LIKE '%!_%' ESCAPE '!' AS has_underscore, url LIKE '%?page=%' AS has_page
FROM pages WHERE url LIKE 'http%example%'"""

# joins and aggregates ---------------------------------------------------------------------

SQL["enrich_lookup"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(r_regionkey AS BIGINT) AS r_regionkey,
       r_name AS region, n_name AS nation, c_acctbal AS balance
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
SQL["left_on_predicate"] = """
SELECT c_custkey, o_orderkey FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'"""
SQL["missing_rows"] = f"""
SELECT CAST(l.l_partkey AS VARCHAR) || ':' || CAST(l.l_suppkey AS VARCHAR) AS flagged_pk, COUNT(*) AS n_lines
FROM lineitem l LEFT JOIN ({r.part_margin()}) p ON p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey
WHERE p.l_partkey IS NULL GROUP BY 1"""
SQL["scalar_ref"] = f"""
SELECT o_orderkey,
  CAST(COALESCE((SELECT SUM(CAST(l_extendedprice AS {MONEY})) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS DOUBLE) AS gross,
  (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines,
  CAST((SELECT MAX(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS last_line
FROM orders"""
SQL["distinct_counts"] = """
SELECT l_suppkey, COUNT(*) AS n_lines, COUNT(DISTINCT l_orderkey) AS n_orders, COUNT(DISTINCT l_partkey) AS n_parts
FROM lineitem GROUP BY l_suppkey"""
SQL["dedup_before_join"] = f"""
SELECT c_custkey, CAST(revenue_calc AS DOUBLE) AS revenue_calc, CAST(revenue_ref AS DOUBLE) AS revenue_ref,
       e.largest AS largest_event
FROM ({r.customer_revenue()}) c
LEFT JOIN (SELECT user_id, MAX(value) AS largest FROM events GROUP BY 1) e ON e.user_id = c_custkey"""
SQL["topk_per_group"] = """
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) t
WHERE rank <= 3"""
SQL["month_shift"] = """
SELECT o_orderkey, YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS month,
       YEAR(moved) * 100 + MONTH(moved) AS shifted
FROM (SELECT *, date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 49 - 24 AS INTEGER)) AS moved
      FROM orders) t"""
_INTEGRAL = """CASE WHEN value = floor(value) THEN CAST(CAST(value AS DECIMAL(38,0)) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"""
SQL["panel_text"] = f"""
SELECT user_id, count(*) AS n_rows, string_agg('event_id=' || event_id || ' | event_type=' || coalesce(event_type, 'None')
  || ' | value=' || coalesce({_INTEGRAL}, 'None'), chr(10) || '  ' ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS panel
FROM events GROUP BY user_id"""
SQL["row_text"] = """
SELECT event_id,
       'event_id=' || CAST(event_id AS VARCHAR) || ' | user_id=' || CAST(user_id AS VARCHAR) || ' | event_type='
       || CASE WHEN event_type = 'error' THEN 'None' ELSE event_type END || ' | value='
       || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END
       AS row_text
FROM events"""

# reconciliation ---------------------------------------------------------------------------

# Decimal places of the amounts that are not plain two-place money.
_PLACES = {"balance_calc": 1, "balance_ref": 1, "average_discount": 4}


def text_of(column: str, kind: str) -> str:
    if kind == r.DBL:
        places = _PLACES.get(column, 2)
        return f"CAST(CAST({column} AS DECIMAL(38,{places})) AS VARCHAR)"
    return f"CAST({column} AS VARCHAR)"


def _wide_rows(defect: str, columns: list[str]) -> str:
    report = r.TRAPS[defect][0]
    pk, kinds = r.PK[report], r.COLUMNS[report]
    parts = [
        f"""SELECT CAST(COALESCE(f.{pk}, t.{pk}) AS VARCHAR) AS flagged_pk, '{c}' AS "column",
        CASE WHEN f.here IS NULL THEN 'missing' WHEN t.here IS NULL THEN 'extra' ELSE 'changed' END AS side,
        {text_of('f.' + c, kinds[c]) if c not in _PLACES else text_of(c, kinds[c]).replace(c, 'f.' + c)} AS reported,
        {text_of('t.' + c, kinds[c]) if c not in _PLACES else text_of(c, kinds[c]).replace(c, 't.' + c)} AS expected
        FROM f FULL JOIN t ON f.{pk} IS NOT DISTINCT FROM t.{pk}
        WHERE f.here IS NULL OR t.here IS NULL OR f.{c} IS DISTINCT FROM t.{c}"""
        for c in columns
    ]
    return f"""WITH f AS (SELECT *, TRUE AS here FROM ({r.trap_sql(defect)}) a),
    t AS (SELECT *, TRUE AS here FROM ({r.clean_sql(report)}) b)
    {union(parts)}"""


def _compared(defect: str) -> list[str]:
    pipeline = PIPELINES[r.TRAPS[defect][0]]
    return [c for c in r.trap_columns(defect) if c not in pipeline.keys]


SQL["diff_wide_rows"] = _wide_rows("NW01", _compared("NW01"))
SQL["diff_wide"] = union(
    f"""SELECT '{d}' AS defect_id, "column", side, COUNT(*) AS n_keys FROM ({_wide_rows(d, _compared(d))}) w
    GROUP BY ALL""" for d in r.TRAPS)
SQL["diff_tolerant"] = f"""
SELECT CAST(f.o_orderkey AS VARCHAR) AS flagged_pk, 'changed' AS side,
       CAST(f.net_value AS DOUBLE) AS reported, CAST(t.net_value AS DOUBLE) AS expected
FROM ({r.trap_sql('NW02')}) f JOIN ({r.clean_sql('order_value')}) t USING (o_orderkey)
WHERE ABS(f.net_value - t.net_value) > 1000"""
SQL["schema_diff"] = union(
    f"""SELECT '{d}' AS defect_id, '{c}' AS column_name, 'missing' AS change, COUNT(*) AS n_rows
    FROM ({r.trap_sql(d)}) t""" for d, (_, _, dropped) in r.TRAPS.items() for c in dropped)
SQL["repeated_keys"] = """
SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS flagged_pk, COUNT(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""

_CLASS = {d.defect_id: i for i, d in enumerate(DEFECTS)}
FLAGGED = union(f"SELECT '{d}' AS defect_id, flagged_pk FROM ({r.diff_sql(d)}) x" for d in r.TRAPS)
GOLD = union(
    f"SELECT '{d}' AS defect_id, {_CLASS[d]} AS class_index, flagged_pk FROM ({r.gold_sql(d)}) x" for d in r.TRAPS)
SQL["bite_gate"] = f"""
SELECT f.defect_id, f.n AS n_flagged, g.n AS n_gold, f.n > 0 AND g.n > 0 AS bites
FROM (SELECT defect_id, COUNT(*) AS n FROM ({FLAGGED}) x GROUP BY 1) f
JOIN (SELECT defect_id, COUNT(*) AS n FROM ({GOLD}) y GROUP BY 1) g USING (defect_id)"""


def _fanout(defect: str, rows: str, report_key: str, join_key: str, child: str, child_key: str) -> str:
    return f"""SELECT '{defect}' AS defect_id, report_key, rows_before, rows_after,
      CAST(ROUND(rows_after / rows_before, 4) AS DOUBLE) AS ratio FROM (
      SELECT a.report_key, a.n AS rows_before, b.n AS rows_after FROM
      (SELECT {report_key} AS report_key, COUNT(*) AS n FROM ({rows}) x GROUP BY 1) a
      JOIN (SELECT {report_key} AS report_key, COUNT(*) AS n FROM ({rows}) x
            LEFT JOIN ({child}) c ON c.{child_key} = x.{join_key} GROUP BY 1) b USING (report_key)) t
      WHERE rows_after > rows_before"""


_SOLD = "SELECT o_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_EV = "SELECT user_id FROM events"
SQL["fanout_profile"] = union([
    _fanout("CH02", _SOLD, "o_custkey", "o_custkey", _EV, "user_id"),
    _fanout("SK01", _SOLD, "o_orderkey", "o_custkey", _EV, "user_id"),
    _fanout("CM01", "SELECT o_orderkey, o_custkey FROM orders", "o_custkey", "o_custkey",
            _EV + " WHERE event_type = 'purchase'", "user_id"),
    _fanout("WO01", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer", "c_nationkey",
            "c_nationkey", "SELECT s_nationkey FROM supplier", "s_nationkey"),
    _fanout("ZT02", "SELECT l_suppkey FROM lineitem", "l_suppkey", "l_suppkey", _EV, "user_id"),
])

# candidate queries ------------------------------------------------------------------------

_CANDIDATES = """
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'blank' WHEN event_id % 29 = 0 THEN 'noted' WHEN event_id % 31 = 0 THEN 'quoted'
  ELSE event_type END AS shape, CAST(user_id AS VARCHAR) AS u FROM events"""
SQL["screen_candidates"] = f"""
SELECT event_id, shape IN ('signup', 'quoted') AS uses_truth,
  CASE WHEN shape = 'blank' THEN 'empty query'
       WHEN shape IN ('signup', 'quoted') THEN 'query must not reference the hidden truth tables'
       WHEN shape = 'purchase' THEN 'only SELECT/WITH statements are allowed'
       WHEN shape = 'error' THEN 'one statement at a time (no '';'')' ELSE '' END AS error,
  shape IN ('view', 'click', 'noted') AS allowed
FROM ({_CANDIDATES}) c"""
SQL["query_references"] = f"""
SELECT event_id,
  CASE WHEN shape = 'blank' THEN '' WHEN shape IN ('view', 'purchase') THEN 'customer_revenue'
       WHEN shape = 'click' THEN 'order_value,t' WHEN shape = 'error' THEN 'part_margin'
       WHEN shape = 'noted' THEN 'customer' WHEN shape = 'quoted' THEN 'part'
       ELSE 'orders,zz_truth' END AS tables_mentioned,
  CASE WHEN shape = 'blank' THEN '' WHEN shape = 'view' THEN 'c_custkey,customer_revenue,revenue_calc'
       WHEN shape = 'click' THEN 'net_value,o_orderkey,order_value,t,with,work'
       WHEN shape = 'purchase' THEN 'c_custkey,customer_revenue,delete'
       WHEN shape = 'error' THEN 'drop,part_margin,t' || u
       WHEN shape = 'noted' THEN 'c_name,customer,event_id,note'
       WHEN shape = 'quoted' THEN 'a,b,main,part,work,zz_hidden'
       ELSE 'orders,revenue_ref,zz_truth' END AS columns_mentioned,
  shape IN ('view', 'signup') AS names_suspect
FROM ({_CANDIDATES}) c"""

_SEEDS = "SELECT CAST(range AS BIGINT) AS episode FROM range(6)"
_SEED = "9001 + {c}.class_index * 10007 + s.episode * 911"
PLANTED = f"""
SELECT defect_id, class_index, episode, seed, rank, flagged_pk FROM (
  SELECT g.defect_id, g.class_index, s.episode, CAST({_SEED.format(c='g')} AS BIGINT) AS seed, g.flagged_pk,
         ROW_NUMBER() OVER (PARTITION BY g.defect_id, s.episode ORDER BY
           md5(CAST({_SEED.format(c='g')} AS VARCHAR) || ':' || g.flagged_pk), g.flagged_pk) AS rank
  FROM ({GOLD}) g CROSS JOIN ({_SEEDS}) s) ranked
WHERE rank <= 3"""
SUSPECTS = f"SELECT defect_id, class_index, episode, seed, flagged_pk FROM ({PLANTED}) p WHERE rank = 1"


def _values(rows: list[tuple], names: str) -> str:
    def one(v):
        return lit(v) if isinstance(v, str) else ("TRUE" if v is True else "FALSE" if v is False else str(v))

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


_MISSING_ROW = tuple(d for d, g in r.GOLD.items() if isinstance(g, str))
_DIM = _values(
    [(d.defect_id, PIPELINES[d.pipeline_id].domain, d.pipeline_id, PIPELINES[d.pipeline_id].pk, d.kind, d.dimension,
      d.category, d.severity, d.description, d.gold_sql(PIPELINES[d.pipeline_id]),
      d.broad_sql(PIPELINES[d.pipeline_id]), ",".join(d.columns),
      ",".join(d.columns[1:]) or "unrelated", d.defect_id in _MISSING_ROW) for d in DEFECTS],
    "defect_id, domain, final_table, pk, defect_kind, dimension, category, severity, description, gold_sql, "
    "broad_sql, columns, others, missing_row")

# Row counts of every report, trap and gold result, from which the verdicts follow.
_COUNT_TRAP = union(f"SELECT '{d}' AS defect_id, COUNT(*) AS n FROM ({r.trap_sql(d)}) x" for d in r.TRAPS)
_COUNT_CLEAN = union(
    f"SELECT '{d}' AS defect_id, n FROM (SELECT COUNT(*) AS n FROM ({r.clean_sql(rep)}) x) y"
    for d, (rep, _, _) in r.TRAPS.items())
_COUNT_GOLD = f"SELECT defect_id, COUNT(*) AS n FROM ({GOLD}) g GROUP BY 1"
_COUNT_GOLD_CLEAN = union(
    f"SELECT '{d}' AS defect_id, COUNT(*) AS n FROM ({r.gold_on(r.clean_sql(rep), d)}) x"
    for d, (rep, _, _) in r.TRAPS.items())
# A broad query returns the reported keys, so it catches a planted key only if that row is there.
_TRAP_KEYS = union(
    f"SELECT '{d}' AS defect_id, CAST({r.PK[rep]} AS VARCHAR) AS pk FROM ({r.trap_sql(d)}) x"
    for d, (rep, _, _) in r.TRAPS.items())
VERDICTS = f"""
WITH planted AS ({PLANTED}),
eps AS (SELECT DISTINCT defect_id, seed FROM planted),
gold AS (SELECT DISTINCT defect_id, flagged_pk FROM ({GOLD}) g),
trap_keys AS ({_TRAP_KEYS}),
gold_hit AS (SELECT DISTINCT p.defect_id, p.seed FROM planted p JOIN gold g USING (defect_id, flagged_pk)),
broad_hit AS (SELECT DISTINCT p.defect_id, p.seed FROM planted p
              JOIN trap_keys k ON k.defect_id = p.defect_id AND k.pk = p.flagged_pk),
n_trap AS ({_COUNT_TRAP}), n_clean AS ({_COUNT_CLEAN}), n_gold AS ({_COUNT_GOLD}), n_gold_clean AS ({_COUNT_GOLD_CLEAN})
SELECT e.defect_id, 'gold' AS candidate, e.seed, TRUE AS valid, h.seed IS NOT NULL AS catch, c.n > 0 AS fp,
       g.n AS n_caught, c.n AS n_clean, '' AS error
FROM eps e JOIN n_gold g USING (defect_id) JOIN n_gold_clean c USING (defect_id)
LEFT JOIN gold_hit h ON h.defect_id = e.defect_id AND h.seed = e.seed
UNION ALL
SELECT e.defect_id, 'broad', e.seed, TRUE, h.seed IS NOT NULL, c.n > 0, t.n, c.n, ''
FROM eps e JOIN n_trap t USING (defect_id) JOIN n_clean c USING (defect_id)
LEFT JOIN broad_hit h ON h.defect_id = e.defect_id AND h.seed = e.seed
UNION ALL SELECT defect_id, 'lookup', seed, TRUE, FALSE, TRUE, 1, 1, '' FROM eps
UNION ALL SELECT defect_id, 'unknown column', seed, FALSE, FALSE, FALSE, 0, 0, 'unknown column' FROM eps
UNION ALL SELECT defect_id, 'truth', seed, FALSE, FALSE, FALSE, 0, 0,
  'query must not reference the hidden truth tables' FROM eps
UNION ALL SELECT defect_id, 'write', seed, FALSE, FALSE, FALSE, 0, 0,
  'only SELECT/WITH statements are allowed' FROM eps
UNION ALL SELECT defect_id, 'empty', seed, FALSE, FALSE, FALSE, 0, 0, 'empty query' FROM eps"""
SQL["grade_checks"] = f"""
SELECT defect_id, candidate, seed, valid, catch, fp, catch AND NOT fp AS precise,
       CAST(n_caught AS BIGINT) AS n_caught, CAST(n_clean AS BIGINT) AS n_clean, error FROM ({VERDICTS}) v"""

_KINDS = _values([(i, k) for i, k in enumerate(KINDS)], "attempt, kind")
_ANSWERS = f"SELECT s.*, d.* EXCLUDE (defect_id), k.* FROM ({SUSPECTS}) s JOIN ({_DIM}) d USING (defect_id) CROSS JOIN ({_KINDS}) k"
SQL["parse_responses"] = f"""
SELECT defect_id, seed, kind, kind <> 'junk' AS readable,
  CASE WHEN kind = 'junk' THEN NULL WHEN kind = 'empty' THEN '' WHEN kind = 'broad' THEN broad_sql ELSE gold_sql END
    AS diagnostic_sql,
  CASE WHEN kind IN ('junk', 'empty') THEN NULL WHEN kind = 'wrong_table' THEN 'another_table' ELSE final_table END
    AS claimed_table,
  CASE WHEN kind IN ('junk', 'empty') THEN '' WHEN kind = 'wrong_column' THEN others ELSE columns END
    AS claimed_columns,
  CASE WHEN kind IN ('junk', 'empty') THEN NULL ELSE description END AS claimed_transformation,
  CASE WHEN kind IN ('junk', 'empty') THEN NULL ELSE 'recomputation disagrees with the report' END AS claimed_reason,
  CASE WHEN kind IN ('junk', 'empty') THEN NULL ELSE
    'SELECT * FROM ' || final_table || ' WHERE CAST(' || pk || ' AS STRING) IS NOT DISTINCT FROM ''' || flagged_pk || '''' END
    AS extraction_request
FROM ({_ANSWERS}) a"""
_SHARED_COLUMN = "others <> 'unrelated'"
SQL["grade_localization"] = f"""
SELECT defect_id, seed, kind, kind IN ('gold', 'broad', 'wrong_column') AS table_ok,
  kind IN ('gold', 'broad', 'wrong_table') OR (kind = 'wrong_column' AND {_SHARED_COLUMN}) AS columns_ok,
  kind IN ('gold', 'broad', 'wrong_table') AS primary_ok,
  CASE WHEN kind IN ('gold', 'broad', 'wrong_table')
       THEN array_to_string(list_sort(string_split(columns, ',')), ',')
       WHEN kind = 'wrong_column' AND {_SHARED_COLUMN} THEN others ELSE '' END AS overlap,
  kind IN ('gold', 'broad') AS loc
FROM ({_ANSWERS}) a"""
# Steps per pipeline, hence the score of a walk that stops one step short.
_STEPS = _values([(d.defect_id, len(PIPELINES[d.pipeline_id].steps)) for d in DEFECTS], "defect_id, n_steps")
_ATTEMPTS = f"""
SELECT a.defect_id, a.seed, a.attempt, a.kind, a.domain,
  a.kind IN ('gold', 'broad', 'wrong_table', 'wrong_column') AS valid,
  CASE WHEN a.kind IN ('gold', 'wrong_table', 'wrong_column') THEN g.catch WHEN a.kind = 'broad' THEN b.catch
       ELSE FALSE END AS catch,
  CASE WHEN a.kind IN ('gold', 'wrong_table', 'wrong_column') THEN g.fp WHEN a.kind = 'broad' THEN b.fp
       ELSE FALSE END AS fp,
  CASE WHEN a.kind IN ('gold', 'wrong_table', 'wrong_column') THEN g.n_caught WHEN a.kind = 'broad' THEN b.n_caught
       ELSE 0 END AS n_caught,
  CASE WHEN a.kind IN ('gold', 'wrong_table', 'wrong_column') THEN g.n_clean WHEN a.kind = 'broad' THEN b.n_clean
       ELSE 0 END AS n_clean,
  a.kind IN ('gold', 'broad') AS loc,
  CASE a.kind WHEN 'gold' THEN 1.0 WHEN 'wrong_column' THEN 0.6
       WHEN 'wrong_table' THEN ROUND(CAST((n_steps - 1) AS DOUBLE) / n_steps * 0.6 + 0.25, 4)
       ELSE 0.0 END AS walkthrough
FROM ({_ANSWERS}) a JOIN ({_STEPS}) n USING (defect_id)
LEFT JOIN verdicts g ON g.defect_id = a.defect_id AND g.seed = a.seed AND g.candidate = 'gold'
LEFT JOIN verdicts b ON b.defect_id = a.defect_id AND b.seed = a.seed AND b.candidate = 'broad'"""
GRADED = f"""
WITH verdicts AS ({VERDICTS}), attempts AS ({_ATTEMPTS}),
judged AS (SELECT *, catch AND NOT fp AS precise, valid AND catch AND NOT fp AND loc AS success FROM attempts)
SELECT *, CASE WHEN catch THEN 0.40 WHEN valid THEN 0.12 ELSE 0.00 END
        + CASE WHEN valid AND NOT fp THEN 0.20 ELSE 0.00 END + CASE WHEN loc THEN 0.20 ELSE 0.00 END
        + CASE WHEN valid THEN 0.20 ELSE 0.00 END AS reward
FROM judged"""
SQL["grade_response"] = f"""
SELECT defect_id, seed, kind, valid, catch, fp, precise, loc, success,
  CAST(n_caught AS BIGINT) AS n_caught, CAST(n_clean AS BIGINT) AS n_clean,
  kind NOT IN ('junk', 'empty') AS extraction_useful
FROM ({GRADED}) g"""
_REQUESTS = _values([(i, v) for i, v in enumerate(("plain", "respelled", "whole", "unknown column", "write", "fault"))], "i, variant")
SQL["extraction_requests"] = f"""
WITH trap_keys AS ({_TRAP_KEYS}), n_trap AS ({_COUNT_TRAP}),
one AS (SELECT s.defect_id, s.seed, s.class_index, COUNT(k.pk) AS n FROM ({SUSPECTS}) s
        LEFT JOIN trap_keys k ON k.defect_id = s.defect_id AND k.pk = s.flagged_pk GROUP BY 1, 2, 3)
SELECT o.defect_id, o.seed, v.variant,
  CASE WHEN variant IN ('plain', 'respelled') THEN o.n WHEN variant = 'whole' THEN CAST(t.n AS BIGINT) END AS extraction_rows,
  CASE variant WHEN 'unknown column' THEN 'unknown column' WHEN 'write' THEN 'only SELECT/WITH statements are allowed'
       WHEN 'fault' THEN 'USER_RAISED_EXCEPTION' ELSE '' END AS extraction_error,
  variant IN ('plain', 'respelled', 'whole') AS extraction_useful
FROM one o JOIN n_trap t USING (defect_id) CROSS JOIN ({_REQUESTS}) v
WHERE variant <> 'fault' OR o.class_index = 0"""
SQL["reward"] = f"""
SELECT defect_id, seed, kind, valid AS valid_output, CAST(0 AS DOUBLE) AS bonus, CAST(reward AS DOUBLE) AS reward
FROM ({GRADED}) g"""
SQL["best_of_n"] = f"""
SELECT defect_id, seed, n_attempts, CAST(attempt AS BIGINT) AS attempt, kind, success, precise, catch, valid,
       CAST(walkthrough AS DOUBLE) AS walkthrough FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY defect_id, seed) AS n_attempts,
         ROW_NUMBER() OVER (PARTITION BY defect_id, seed
           ORDER BY success DESC, precise DESC, catch DESC, valid DESC, walkthrough DESC, attempt) AS place
  FROM ({GRADED}) g WHERE kind <> 'gold') t WHERE place = 1"""
SQL["best_by_reward"] = f"""
SELECT defect_id, seed, CAST(attempt AS BIGINT) AS attempt, kind, CAST(reward AS DOUBLE) AS reward FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY defect_id, seed ORDER BY reward DESC, attempt) AS place
  FROM ({GRADED}) g WHERE kind <> 'gold') t WHERE place = 1"""


def _metrics(by: str, column: str) -> str:
    shares = ", ".join(
        f"CAST(ROUND(AVG(CAST({m} AS INTEGER)), 4) AS DOUBLE) AS {m}"
        for m in ("valid", "catch", "fp", "precise", "loc", "success"))
    return f"""SELECT '{by}' AS "by", {column} AS value, COUNT(*) AS n, {shares},
    CAST(ROUND(AVG(CAST(walkthrough AS DOUBLE)), 4) AS DOUBLE) AS walkthrough FROM graded GROUP BY {column}"""


SQL["metrics_summary"] = f"""WITH graded AS ({GRADED})
{union([_metrics('attempt', 'kind'), _metrics('defect', 'defect_id'), _metrics('domain', 'domain')])}"""
SQL["score_transcripts"] = """
WITH turns AS (
  SELECT user_id, event_type, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn,
         CASE WHEN event_id % 11 = 0 THEN 'note'
              WHEN event_type = 'purchase' AND value > 150 THEN 'localize'
              WHEN event_type IN ('view', 'purchase', 'error') THEN 'sql' ELSE 'hypothesis' END AS action
  FROM events),
counted AS (
  SELECT *, SUM(CASE WHEN action = 'sql' AND event_type <> 'error' THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY turn) AS q FROM turns),
closing AS (
  SELECT user_id, MIN(turn) AS ended_at FROM counted
  WHERE action <> 'note' AND (action = 'localize' OR q >= 12 OR turn >= 24) GROUP BY 1),
live AS (SELECT c.*, k.ended_at FROM counted c LEFT JOIN closing k USING (user_id)
         WHERE c.action <> 'note' AND (k.ended_at IS NULL OR c.turn <= k.ended_at)),
scored AS (
  SELECT user_id, MAX(q) AS queries, MAX(ended_at) AS ended_at,
         COUNT(*) FILTER (WHERE action = 'hypothesis' AND event_id % 3 = 0) AS n_correct,
         MAX(CASE WHEN turn = ended_at AND action = 'localize' THEN CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.8 END END) AS terminal,
         BOOL_OR(turn = ended_at AND action = 'localize' AND event_id % 2 = 0) AS success,
         MAX(CASE WHEN turn = ended_at AND action <> 'localize' THEN
             CASE WHEN q >= 12 THEN 'query budget exhausted without localisation'
                  ELSE 'turn budget exhausted without localisation' END END) AS reason
  FROM live GROUP BY 1)
SELECT n.user_id, n.n AS n_logged, n.n_unknown, CAST(COALESCE(queries, 0) AS BIGINT) AS queries,
       ended_at, COALESCE(n_correct, 0) AS n_correct, CAST(terminal AS DOUBLE) AS terminal_reward,
       CAST(COALESCE(terminal, 0) + COALESCE(n_correct, 0) * 0.05 AS DOUBLE) AS total_reward,
       COALESCE(success, FALSE) AS success, reason
FROM (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE action = 'note') AS n_unknown FROM turns GROUP BY 1) n
LEFT JOIN scored s USING (user_id)"""

# lineage and the risk model ---------------------------------------------------------------

_CONTRACTS = """
SELECT *, CAST(ROUND(VALOR_INICIAL * (1 - HAIRCUT), 2) AS DECIMAL(18,2)) AS VALOR_NETO FROM (
  SELECT ID_CONTRATO, SEGMENTO, GARANTIA_TIPO,
    CAST(CASE GARANTIA_TIPO WHEN 'HIPOTECA' THEN 120000 + (ID_CONTRATO % 380000 * 1009) % 380000
              WHEN 'PRENDA' THEN 10000 + (ID_CONTRATO % 80000 * 1009) % 80000 ELSE 0 END AS DECIMAL(18,2)) AS VALOR_INICIAL,
    CAST(CASE WHEN GARANTIA_TIPO = 'NINGUNA' THEN 0 ELSE CAST(200 + ID_CONTRATO % 600 AS DECIMAL(6,0)) * 0.0001 END
         AS DECIMAL(6,4)) AS HAIRCUT
  FROM (SELECT *, CASE SEGMENTO WHEN 'RETAIL_HIP' THEN 'HIPOTECA' WHEN 'SME' THEN 'PRENDA' ELSE 'NINGUNA' END AS GARANTIA_TIPO
        FROM (SELECT c_custkey AS ID_CONTRATO,
                CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CORP' WHEN 'MACHINERY' THEN 'SME'
                     WHEN 'BUILDING' THEN 'RETAIL_HIP' ELSE 'RETAIL_CONS' END AS SEGMENTO FROM customer) s) k) v"""
_INPUTS = f"""
SELECT o_orderkey AS ID_CICLO, o_custkey AS ID_CONTRATO,
  CAST(YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS BIGINT) AS MES, SEGMENTO, GARANTIA_TIPO,
  CAST(o_totalprice AS {MONEY}) AS OR_DISPTO, CAST(ROUND(COALESCE(u.v, 0), 2) AS {MONEY}) AS OR_DISBLE,
  CAST(0.75 AS {RATE}) AS CCF,
  CAST(CAST(CASE WHEN o_orderkey % 16 + 1 <= 4 THEN 600 + 19400 * (o_orderkey % 1000 * 7919 % 1000) // 1000
        WHEN o_orderkey % 16 + 1 <= 8 THEN 10000 + 40000 * (o_orderkey % 1000 * 7919 % 1000) // 1000
        WHEN o_orderkey % 16 + 1 <= 12 THEN 30000 + 90000 * (o_orderkey % 1000 * 7919 % 1000) // 1000
        ELSE 80000 + 100000 * (o_orderkey % 1000 * 7919 % 1000) // 1000 END AS DECIMAL(12,0)) * 0.000001 AS DECIMAL(18,6)) AS PD_ESTIMADA,
  CAST(CAST(50000 + (o_orderkey % 870000 * 104729) % 870000 AS DECIMAL(12,0)) * 0.000001 AS DECIMAL(18,6)) AS LGD_ESTIMADA,
  CAST((o_orderkey % 401 * 37) % 401 AS BIGINT) AS DPDS,
  CASE WHEN o_orderkey % 5 < 2 THEN 'CERRADO' ELSE 'ESTIMACION' END AS ESTADO,
  CAST(ROUND(CAST(o_totalprice AS {MONEY}) * CAST((o_orderkey % 551 * 13) % 551 AS DECIMAL(10,0)) * 0.001, 2) AS {MONEY}) AS RECUPERACION,
  CAST(ROUND(CAST(o_totalprice AS {MONEY}) * CAST((o_orderkey % 81 * 17) % 81 AS DECIMAL(10,0)) * 0.001, 2) AS {MONEY}) AS COSTE
FROM orders
LEFT JOIN (SELECT l_orderkey AS k, SUM(CAST(l_extendedprice AS {MONEY}) * CAST(l_tax AS {RATE})) AS v
           FROM lineitem GROUP BY 1) u ON u.k = o_orderkey
LEFT JOIN ({_CONTRACTS}) c ON c.ID_CONTRATO = o_custkey"""
_PLANTED_CYCLES = """
SELECT o_orderkey AS k FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 3"""


def risk_wide(planted: bool, scale: int = 1) -> str:
    wrong = f"ID_CICLO IN (SELECT k FROM ({_PLANTED_CYCLES}) p)" if planted else "FALSE"
    return f"""
SELECT *, EAD_TOTAL_D * LGD_FINAL_D * 12.5::DOUBLE * K_IRB AS RWA, ECL AS PROVISION FROM (
 SELECT *, SQRT(PD_FINAL_D) * 0.06::DOUBLE + PD_FINAL_D * 0.5::DOUBLE AS K_IRB,
   PD_FINAL_D * LGD_FINAL_D * EAD_TOTAL_D AS ECL,
   CASE WHEN ESTADO = 'CERRADO' THEN ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE,
     1.0::DOUBLE - COALESCE(CAST(RECUPERACION - COSTE AS DOUBLE) / NULLIF(EAD_TOTAL_D, 0), 1.0::DOUBLE))), 6)
     ELSE 0.0::DOUBLE END AS LGD_REALIZADA FROM (
  SELECT *, CAST(PD_FINAL AS DOUBLE) AS PD_FINAL_D, CAST(LGD_FINAL AS DOUBLE) AS LGD_FINAL_D,
    CAST(EAD_TOTAL AS DOUBLE) AS EAD_TOTAL_D FROM (
   SELECT *, GREATEST(PD_ESTIMADA, PD_SUELO) AS PD_FINAL,
     LEAST(1, CAST(PD_ESTIMADA * 1.5 AS DECIMAL(18,8))) AS PD_DOWNTURN,
     GREATEST(LGD_CON_MOC, LGD_SUELO) AS LGD_FINAL,
     LEAST(1, CAST(LGD_ESTIMADA * 1.15 AS DECIMAL(18,8))) AS LGD_DOWNTURN,
     CAST(EAD_BALANCE + EAD_FUERA AS DECIMAL(28,4)) AS EAD_TOTAL FROM (
    SELECT *, {wrong} AS is_planted,
      CAST(CASE WHEN GARANTIA_TIPO = 'HIPOTECA' THEN 0.0005 ELSE 0.0003 END AS DECIMAL(18,6)) AS PD_SUELO,
      CAST(CASE WHEN GARANTIA_TIPO = 'HIPOTECA' THEN 0.30 WHEN SEGMENTO = 'CORP' THEN 0.45 ELSE 0 END AS DECIMAL(18,8)) AS LGD_SUELO,
      CAST(LGD_ESTIMADA * 1.05 AS DECIMAL(18,8)) AS LGD_CON_MOC, OR_DISPTO AS EAD_BALANCE,
      CAST(CASE WHEN {wrong} THEN CCF * OR_DISPTO * {scale} ELSE CCF * OR_DISBLE END AS DECIMAL(28,4)) AS EAD_FUERA,
      CAST(CASE WHEN DPDS < 30 THEN 1 WHEN DPDS < 90 THEN 2 ELSE 3 END AS BIGINT) AS STAGE
    FROM ({_INPUTS}) i) a) b) c) d"""


_DOUBLES = ("OR_DISPTO", "OR_DISBLE", "CCF", "PD_ESTIMADA", "LGD_ESTIMADA", "RECUPERACION", "COSTE", "PD_SUELO",
            "LGD_SUELO", "LGD_CON_MOC", "EAD_BALANCE", "EAD_FUERA", "PD_FINAL", "PD_DOWNTURN", "LGD_FINAL",
            "LGD_DOWNTURN", "EAD_TOTAL", "K_IRB", "ECL", "LGD_REALIZADA", "RWA", "PROVISION")
_PLAIN = ("ID_CICLO", "ID_CONTRATO", "MES", "SEGMENTO", "GARANTIA_TIPO", "DPDS", "ESTADO", "STAGE")


def _risk_columns(names) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" if n in _DOUBLES else n for n in names)


SQL["risk_columns"] = f"SELECT {_risk_columns(_PLAIN + _DOUBLES)} FROM ({risk_wide(False)}) w"
_RISK_MEASURE = {"t2_basilea": "OR_DISBLE", "t4_ciclos": "RECUPERACION", "t5_pd_cal": "PD_FINAL",
                 "t6_lgd_cal": "LGD_FINAL", "t7_ead_cal": "EAD_FUERA", "t8_final": "EAD_TOTAL"}
_USED = "WHERE ID_CONTRATO IN (SELECT o_custkey FROM orders)"
SQL["risk_tables"] = f"WITH w AS ({risk_wide(False)}) " + union(
    [f"""SELECT '{t}' AS table_name, COUNT(*) AS n_rows, COUNT(DISTINCT ID_CICLO) AS n_keys,
     CAST(SUM(CAST({c} AS DECIMAL(28,8))) AS DOUBLE) AS total FROM w""" for t, c in _RISK_MEASURE.items()]
    + [f"""SELECT 't1_contratos', COUNT(*), COUNT(DISTINCT ID_CONTRATO), CAST(0 AS DOUBLE) FROM ({_CONTRACTS}) k {_USED}""",
       f"""SELECT 't3_colaterales', COUNT(*), COUNT(DISTINCT ID_CONTRATO), CAST(SUM(VALOR_NETO) AS DOUBLE)
       FROM ({_CONTRACTS}) k {_USED}"""])
_TRAP_WIDE = risk_wide(True)
SQL["risk_trap"] = f"""SELECT is_planted, {_risk_columns(
    ('ID_CICLO', 'EAD_FUERA', 'EAD_TOTAL', 'ECL', 'RWA', 'PROVISION', 'LGD_REALIZADA'))} FROM ({_TRAP_WIDE}) w"""
SQL["risk_trap_scaled"] = f"""SELECT is_planted, {_risk_columns(('ID_CICLO', 'EAD_FUERA', 'EAD_TOTAL', 'ECL'))}
FROM ({risk_wide(True, 1000)}) w"""
SQL["invariant_leaf"] = f"""
SELECT ID_CICLO FROM ({_TRAP_WIDE}) w WHERE ABS(ECL - PD_FINAL_D * LGD_FINAL_D * EAD_TOTAL_D) > 0.01"""
SQL["invariant_cross_table"] = f"""
SELECT e.ID_CICLO FROM ({_TRAP_WIDE}) e JOIN ({_INPUTS}) b
  ON e.ID_CICLO = b.ID_CICLO AND e.ID_CONTRATO = b.ID_CONTRATO AND e.MES = b.MES
WHERE ABS(e.EAD_FUERA - b.CCF * b.OR_DISBLE) > 0.01"""
SQL["invariant_verdict"] = f"""
WITH x AS ({SQL['invariant_cross_table']}), l AS ({SQL['invariant_leaf']})
SELECT 'cross_table' AS check_name, TRUE AS valid, '' AS error, (SELECT COUNT(*) FROM x) AS trap_rows, CAST(0 AS BIGINT) AS clean_rows,
       (SELECT COUNT(*) FROM x JOIN ({_PLANTED_CYCLES}) p ON p.k = x.ID_CICLO) > 0 AS caught, FALSE AS false_positive
UNION ALL SELECT 'leaf', TRUE, '', (SELECT COUNT(*) FROM l), 0, FALSE, FALSE
UNION ALL SELECT 'misnamed', FALSE, 'UNRESOLVED_COLUMN.WITH_SUGGESTION', NULL, NULL, FALSE, FALSE"""
SQL["suspect_list"] = f"""
SELECT {_risk_columns(RISK_TABLES['t8_final'])} FROM ({_TRAP_WIDE}) w WHERE is_planted"""
_EXTRACT = ("ID_CICLO", "ID_CONTRATO", "MES", "EAD_BALANCE", "EAD_FUERA", "EAD_TOTAL", "OR_DISPTO", "OR_DISBLE", "CCF")
SQL["key_extraction"] = f"""
SELECT {_risk_columns(_EXTRACT)}, CAST(ROUND(CCF * OR_DISBLE, 2) AS DOUBLE) AS EXPECTED_FUERA
FROM ({_TRAP_WIDE}) w WHERE is_planted"""


def _closure(field: str) -> dict[str, int]:
    """Inputs of a field with their distance, level by level."""
    found: dict[str, int] = {}
    level, depth = {field}, 0
    while level:
        depth += 1
        level = {s for f in level for s in FIELD_DEPENDENCIES.get(f, ())} - found.keys()
        found |= {f: depth for f in level}
    return found


_FIELD_TEXT = {f: f"CAST({f} AS VARCHAR)" for f in (
    *FIELD_DEPENDENCIES, *(s for sources in FIELD_DEPENDENCIES.values() for s in sources))}
SQL["lineage_closure"] = f"WITH w AS (SELECT * FROM ({_TRAP_WIDE}) x WHERE is_planted) " + union(
    f"SELECT ID_CICLO, '{f}' AS field, {_FIELD_TEXT[f]} AS value, CAST({depth} AS BIGINT) AS depth FROM w"
    for f, depth in sorted(_closure("ECL").items()))


def _row_text(columns: dict[str, str]) -> str:
    return " || ' | ' || ".join(f"'{c}=' || COALESCE({text_of(c, t)}, 'None')" for c, t in columns.items())


def _suspect_rows() -> str:
    parts = []
    for d, (report, _, _) in r.TRAPS.items():
        pk = r.PK[report]
        parts.append(f"""
SELECT s.defect_id, s.seed, s.flagged_pk, f.row_text IS NULL AS is_missing, COALESCE(f.row_text, t.row_text) AS row_text
FROM suspects s
LEFT JOIN (SELECT CAST({pk} AS VARCHAR) AS k, {_row_text(r.trap_columns(d))} AS row_text FROM ({r.trap_sql(d)}) a) f
  ON f.k = s.flagged_pk
LEFT JOIN (SELECT CAST({pk} AS VARCHAR) AS k, {_row_text(r.COLUMNS[report])} AS row_text FROM ({r.clean_sql(report)}) b) t
  ON t.k = s.flagged_pk
WHERE s.defect_id = '{d}'""")
    return f"WITH suspects AS ({SUSPECTS}) {union(parts)}"


SQL["suspect_rows"] = _suspect_rows()
_ORDER_STAGE = ("orders", {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority", "o_orderdate": "CAST(o_orderdate AS DATE)",
    "order_total": f"CAST(o_totalprice AS {MONEY})"})
_LINE_STAGE = (f"(WITH {r.LINES} SELECT * FROM lines) z", {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
    "l_returnflag": "l_returnflag", "ship_day": "CAST(l_shipdate AS DATE)", "quantity": "quantity", "gross": "gross",
    "discount": "discount", "net": "net"})
_PART_STAGE = ("part", {"p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "p_brand",
                        "list_price": f"CAST(p_retailprice AS {MONEY})"})
_SUPPLIER_STAGE = ("supplier", {"s_suppkey": "s_suppkey", "s_nationkey": "s_nationkey", "unnamed": "s_name IS NULL",
                                "balance": f"CAST(s_acctbal AS {MONEY})"})


def _same(table: str, *names: str):
    return table, {n: n for n in names}


# report -> staging step -> (source, column -> expression)
STAGES = {
    "customer_revenue": {"stg_lines": _LINE_STAGE, "stg_orders": _ORDER_STAGE},
    "order_value": {"stg_lines": _LINE_STAGE, "stg_parts": _PART_STAGE, "stg_orders": _ORDER_STAGE},
    "order_performance": {"stg_orders": _ORDER_STAGE, "stg_lines": _LINE_STAGE, "stg_suppliers": _SUPPLIER_STAGE},
    "sales_by_customer": {"stg_orders": _ORDER_STAGE, "stg_purchases": (
        "events WHERE event_type = 'purchase'",
        {"event_id": "event_id", "user_id": "user_id", "amount": f"CAST(value AS {MONEY})"})},
    "nation_profile": {"stg_customers": ("customer", {
        "c_custkey": "c_custkey", "c_nationkey": "c_nationkey", "balance": f"CAST(c_acctbal AS {MONEY})"}),
        "stg_suppliers": _SUPPLIER_STAGE},
    "supplier_season": {"stg_lines": _LINE_STAGE, "stg_orders": ("orders", {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_year": "YEAR(o_orderdate)",
        "o_month": "MONTH(o_orderdate)"})},
    "part_margin": {"stg_lines": _LINE_STAGE, "stg_orders": _same(
        "orders WHERE o_orderstatus = 'O'", "o_orderkey", "o_custkey", "o_orderstatus")},
    "item_sales": {"stg_lines": _LINE_STAGE, "stg_dates": ("lineitem", {
        "d_day": "CAST(l_shipdate AS DATE)", "d_year": "YEAR(l_shipdate)", "d_month": "MONTH(l_shipdate)"}),
        "stg_parts": _PART_STAGE},
    "supplier_stats": {"stg_lines": _LINE_STAGE, "stg_suppliers": _same("supplier", "s_suppkey", "s_name", "s_nationkey")},
    "order_stats": {
        "stg_orders": _same("orders WHERE o_orderstatus IN ('F', 'O')", "o_orderkey", "o_orderstatus", "o_orderpriority"),
        "stg_returns": ("""(SELECT l_orderkey, COUNT(*) AS n,
          CAST(CAST((200 * SUM(CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) + COUNT(*)) // (2 * COUNT(*))
               AS DOUBLE) / 10000 AS DECIMAL(18,4)) AS a
          FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) z""",
            {"o_orderkey": "l_orderkey", "average_discount": "a", "n_returned": "n"}),
        "stg_line_counts": ("(SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) z",
                            {"o_orderkey": "l_orderkey", "n_lines": "n"})},
    "supplier_sales": {"stg_suppliers": (
        "supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
        {"s_suppkey": "s_suppkey", "supplier_name": "s_name", "nation": "n_name", "region": "r_name"}),
        "stg_lines": _LINE_STAGE},
    "region_stats": {"stg_customers": (
        "customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
        {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "c_nationkey", "r_regionkey": "r_regionkey",
         "region": "r_name", "nation": "n_name", "balance": f"CAST(c_acctbal AS {MONEY})"})},
}


def _stage_row(report: str, step: str) -> str:
    source, columns = STAGES[report][step]
    shown = " || ' | ' || ".join(f"'{c}=' || COALESCE(CAST({c} AS VARCHAR), 'None')" for c in columns)
    inner = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return f"(SELECT {shown} FROM (SELECT {inner} FROM {source}) q ORDER BY {order} LIMIT 1)"


def _walk_steps() -> str:
    parts = []
    for d in DEFECTS:
        pipeline = PIPELINES[d.pipeline_id]
        for position, step in enumerate(reversed(pipeline.steps)):
            evidence = "s.row_text" if position == 0 else _stage_row(d.pipeline_id, step.name)
            parts.append(f"""SELECT s.defect_id, s.seed, s.flagged_pk AS suspect_pk, CAST({position} AS BIGINT) AS position,
            '{step.layer}' AS layer, '{step.name}' AS table_name, {evidence} AS evidence
            FROM rows s WHERE s.defect_id = '{d.defect_id}'""")
    return f"WITH rows AS ({SQL['suspect_rows']}) {union(parts)}"


SQL["layer_walk"] = _walk_steps()
_WALK_KINDS = "SELECT * FROM (VALUES ('gold'), ('short'), ('reversed')) v(variant)"
SQL["layer_walk_score"] = f"""
SELECT s.defect_id, s.seed, variant, CAST(n_steps - (variant = 'short')::INT AS BIGINT) AS n_steps,
  CAST(n_steps - (variant = 'short')::INT AS BIGINT) AS ran, variant <> 'reversed' AS final_ok,
  variant = 'gold' AS layers_ok,
  CAST(CASE variant WHEN 'gold' THEN 1.0 WHEN 'reversed' THEN 0.6
       ELSE ROUND(CAST(n_steps - 1 AS DOUBLE) / n_steps * 0.6 + 0.25, 4) END AS DOUBLE) AS score
FROM ({SUSPECTS}) s JOIN ({_STEPS}) n USING (defect_id) CROSS JOIN ({_WALK_KINDS}) k"""

# samples and episodes ---------------------------------------------------------------------

SQL["planted_sample"] = f"SELECT defect_id, seed, rank, flagged_pk FROM ({PLANTED}) p"
SQL["seed_grid"] = f"""
SELECT c.defect_id, CAST(c.class_index AS BIGINT) AS class_index, s.episode,
       CAST({_SEED.format(c='c')} AS BIGINT) AS seed, f.n_flagged
FROM (SELECT defect_id, COUNT(*) AS n_flagged FROM ({FLAGGED}) x GROUP BY 1) f
JOIN ({_values(list((d, i) for d, i in _CLASS.items()), 'defect_id, class_index')}) c USING (defect_id)
CROSS JOIN ({_SEEDS}) s"""
SQL["stratified_split_all"] = f"""
SELECT defect_id, flagged_pk, number,
  CASE WHEN number < GREATEST(1, CEIL(COUNT(*) OVER (PARTITION BY defect_id) * 0.2)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT defect_id, flagged_pk, ROW_NUMBER() OVER (PARTITION BY defect_id ORDER BY
        md5(CAST(9001 + class_index * 10007 AS VARCHAR) || ':' || flagged_pk), flagged_pk) - 1 AS number
      FROM ({GOLD}) g) ranked"""

SQL["stratified_split"] = f"SELECT defect_id, flagged_pk, split FROM ({SQL['stratified_split_all']}) s"


def _contexts() -> str:
    """The text of each defect before the suspect key, from the declared source columns."""
    from contract.source_columns import SOURCE_COLUMNS

    rows = []
    for d in DEFECTS:
        p = PIPELINES[d.pipeline_id]
        tables = {t: list(c) for t, c in SOURCE_COLUMNS.items()}
        tables |= {step: list(columns) for step, (_, columns) in STAGES[p.pipeline_id].items()}
        tables[p.final_table] = list(r.COLUMNS[p.pipeline_id])
        listed = "\n".join(f"  {t}  ({', '.join(tables[t])})" for t in sorted(tables))
        rows.append((d.defect_id, f"TABLES PRESENT (table: columns):\n{listed}\n\nPIPELINE LINEAGE "
                     f"({p.final_table} is the reported table)\n{p.lineage}\n\nSUSPECT ROW\n  {p.pk} = "))
    return _values(rows, "defect_id, context")


EPISODES = f"""
WITH planted AS ({PLANTED}), rows AS ({SQL['suspect_rows']}), dim AS ({_DIM}), contexts AS ({_contexts()}),
keys AS (SELECT defect_id, seed, string_agg(flagged_pk, ',' ORDER BY rank) AS planted_pks FROM planted GROUP BY 1, 2)
SELECT {lit(episodes.SCHEMA_VERSION)} AS schema,
  p.defect_id || '_' || lpad(CAST(p.episode AS VARCHAR), 3, '0') AS episode_id,
  d.final_table AS pipeline_id, p.defect_id, d.defect_kind, d.dimension, d.category, d.severity,
  CASE WHEN p.episode < 2 THEN 'test' ELSE 'train' END AS split, p.seed, k.planted_pks,
  p.flagged_pk AS suspect_pk, w.is_missing,
  c.context || p.flagged_pk || {lit(chr(10) + '  ')} || w.row_text || {lit(chr(10) * 2 + episodes.TASK)} AS user,
  CAST(1 AS DOUBLE) AS reward
FROM planted p JOIN keys k USING (defect_id, seed) JOIN rows w USING (defect_id, seed)
JOIN dim d USING (defect_id) JOIN contexts c USING (defect_id)
WHERE p.rank = 1"""
# A gold answer passes every rule, so only its counts and its steps differ from episode to episode.
SQL["episodes"] = f"""
WITH steps AS ({SQL['layer_walk']}), verdicts AS ({VERDICTS}), dim AS ({_DIM}), e AS ({EPISODES}),
walks AS (SELECT defect_id, seed, COUNT(*) AS n, string_agg(
    position || ' ' || layer || ' ' || table_name || ' ' || CASE WHEN position = 0 THEN suspect_pk ELSE '-' END || ': '
    || COALESCE(evidence, '-'), chr(10) ORDER BY position) AS walk FROM steps GROUP BY 1, 2)
SELECT e.*, w.walk,
  d.final_table || '.' || string_split(d.columns, ',')[1] || ': ' || string_split(d.columns, ',')[1]
    || ' does not follow from the joins upstream' AS hypotheses,
  '{{"response":{{"valid":true,"catch":true,"fp":false,"precise":true,"loc":true,"success":true,"n_caught":' || v.n_caught
    || ',"n_clean":0}},"walkthrough":{{"score":1.0,"n_steps":' || w.n || ',"ran":' || w.n
    || ',"final_ok":true,"layers_ok":true}}}}' AS verdict
FROM e JOIN walks w USING (defect_id, seed) JOIN dim d USING (defect_id)
JOIN verdicts v ON v.defect_id = e.defect_id AND v.seed = e.seed AND v.candidate = 'gold'"""
SQL["split_stats"] = f"WITH e AS ({EPISODES}) " + union(
    f"""SELECT '{c}' AS dimension, {c} AS value, COUNT(*) AS n, COUNT(*) FILTER (WHERE split = 'test') AS n_test,
    CAST(ROUND(AVG(CASE WHEN split = 'test' THEN 1 ELSE 0 END), 4) AS DOUBLE) AS test_share FROM e GROUP BY {c}"""
    for c in ("pipeline_id", "defect_kind", "dimension", "defect_id", "schema"))
SQL["planted_drift"] = f"""
WITH planted AS (
  SELECT defect_id, seed, class_index * 6 + episode AS n, list(flagged_pk ORDER BY rank) AS keys
  FROM ({PLANTED}) p GROUP BY defect_id, class_index, episode, seed),
aged AS (SELECT defect_id, seed, n, CASE WHEN n % 7 = 0 THEN list_reverse([k || '''' FOR k IN keys]) ELSE keys END AS keys FROM planted WHERE n % 11 <> 1),
stored AS (SELECT * FROM aged UNION ALL SELECT defect_id, seed + 1, n, keys FROM aged WHERE n % 13 = 2)
SELECT defect_id, seed, array_to_string(s.keys, ',') AS stored_pks, array_to_string(p.keys, ',') AS recomputed_pks,
  CASE WHEN p.keys IS NULL THEN 'dropped' WHEN s.keys IS NULL THEN 'added' WHEN s.keys IS DISTINCT FROM p.keys THEN 'altered' ELSE 'none' END AS drift,
  s.keys IS DISTINCT FROM p.keys AS drifted
FROM planted p FULL JOIN stored s USING (defect_id, seed)"""

SQL["metrics_report"] = f"SELECT *, COUNT(*) OVER () AS published_rows FROM ({SQL['metrics_summary']}) m"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
