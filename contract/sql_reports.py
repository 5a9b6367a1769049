"""The reports and their traps as literal SQL.

Written the plain way, with direct many-to-many joins and correlated intent, so it checks the
pre-aggregated DataFrame plans independently.
"""

from __future__ import annotations

LINES = """
lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_shipdate,
         CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
         CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS net
  FROM lineitem)"""

BIG, DBL, TXT = "BIGINT", "DOUBLE", "VARCHAR"

COLUMNS: dict[str, dict[str, str]] = {
    "customer_revenue": dict(c_custkey=BIG, c_name=TXT, c_mktsegment=TXT, n_orders=BIG,
                             revenue_calc=DBL, revenue_ref=DBL),
    "order_value": dict(o_orderkey=BIG, o_custkey=BIG, o_orderdate=TXT, o_orderstatus=TXT,
                        n_lines=BIG, gross_value=DBL, net_value=DBL, net_value_ref=DBL,
                        list_value=DBL, list_value_ref=DBL),
    "order_performance": dict(o_orderkey=BIG, o_orderstatus=TXT, o_orderpriority=TXT,
                              n_suppliers=BIG, revenue_calc=DBL, revenue_ref=DBL),
    "sales_by_customer": dict(c_custkey=BIG, c_name=TXT, c_nationkey=BIG, n_orders=BIG,
                              revenue_calc=DBL, paid_calc=DBL, paid_ref=DBL, revenue_ref=DBL),
    "nation_profile": dict(n_nationkey=BIG, n_name=TXT, n_regionkey=BIG, n_customers=BIG,
                           largest_balance=DBL, balance_calc=DBL, balance_ref=DBL),
    "supplier_season": dict(row_key=TXT, o_year=BIG, l_suppkey=BIG, s_name=TXT, n_lines=BIG,
                            firsts_calc=BIG, early_lines=BIG, average_line=DBL, firsts_ref=BIG),
    "part_margin": dict(row_key=TXT, l_partkey=BIG, l_suppkey=BIG, total_qty=DBL,
                        net_revenue_calc=DBL, net_revenue_ref=DBL),
    "item_sales": dict(p_partkey=BIG, p_name=TXT, p_brand=TXT, n_orders=BIG, units_calc=DBL,
                       sales_calc=DBL, sales_ref=DBL),
    "supplier_stats": dict(s_suppkey=BIG, s_name=TXT, s_nationkey=BIG, n_lines_calc=BIG,
                           n_kept=BIG, n_parts=BIG, n_lines_ref=BIG),
    "order_stats": dict(o_orderkey=BIG, o_orderstatus=TXT, o_orderpriority=TXT,
                        average_discount=DBL, n_returned=BIG, n_lines_calc=BIG, n_lines_ref=BIG),
    "supplier_sales": dict(s_suppkey=BIG, supplier_name=TXT, nation=TXT, region=TXT, n_lines=BIG,
                           units_calc=DBL, revenue_calc=DBL, revenue_ref=DBL),
    "region_stats": dict(r_regionkey=BIG, r_name=TXT, manager=TXT, n_customers_calc=BIG,
                         n_active_calc=BIG, n_customers_ref=BIG),
}
PK = {name: next(iter(cols)) for name, cols in COLUMNS.items()}


def customer_revenue(line_on="l.l_orderkey = o.o_orderkey", extra=""):
    return f"""WITH {LINES}
    SELECT c.c_custkey, c.c_name, c.c_mktsegment, COUNT(DISTINCT o.o_orderkey) AS n_orders,
           ROUND(COALESCE(SUM(l.net), 0), 2) AS revenue_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 2) AS revenue_ref
    FROM customer c
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey
    LEFT JOIN lines l ON {line_on}
    {extra}
    LEFT JOIN (SELECT o2.o_custkey AS k, SUM(l2.net) AS v FROM orders o2
               JOIN lines l2 ON l2.l_orderkey = o2.o_orderkey GROUP BY 1) ref ON ref.k = c.c_custkey
    GROUP BY c.c_custkey, c.c_name, c.c_mktsegment"""


def order_value(part_on="p.p_partkey = l.l_partkey", net="l.net", with_net_ref=True):
    net_ref = "ROUND(MAX(COALESCE(nref.v, 0)), 2) AS net_value_ref," if with_net_ref else ""
    return f"""WITH {LINES}
    SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS o_orderdate, o.o_orderstatus,
           COUNT(*) AS n_lines, ROUND(SUM(l.gross), 2) AS gross_value,
           ROUND(COALESCE(SUM({net}), 0), 2) AS net_value, {net_ref}
           ROUND(SUM(CAST(p.p_retailprice AS DECIMAL(18,2)) * l.quantity), 2) AS list_value,
           ROUND(MAX(COALESCE(lref.v, 0)), 2) AS list_value_ref
    FROM orders o
    JOIN lines l ON l.l_orderkey = o.o_orderkey
    JOIN part p ON {part_on}
    LEFT JOIN (SELECT l_orderkey AS k, SUM(net) AS v FROM lines GROUP BY 1) nref
      ON nref.k = o.o_orderkey
    LEFT JOIN (SELECT l_orderkey AS k, SUM(CAST(p_retailprice AS DECIMAL(18,2)) * quantity) AS v
               FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1) lref
      ON lref.k = o.o_orderkey
    GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus"""


def order_performance(join="LEFT JOIN", line_on="l.l_orderkey = o.o_orderkey", extra=""):
    return f"""WITH {LINES}
    SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority,
           COUNT(DISTINCT s.s_suppkey) AS n_suppliers,
           ROUND(COALESCE(SUM(l.net), 0), 2) AS revenue_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 2) AS revenue_ref
    FROM orders o
    {extra}
    {join} lines l ON {line_on}
    {join} supplier s ON s.s_suppkey = l.l_suppkey
    LEFT JOIN (SELECT l_orderkey AS k, SUM(net) AS v FROM lines GROUP BY 1) ref
      ON ref.k = o.o_orderkey
    GROUP BY o.o_orderkey, o.o_orderstatus, o.o_orderpriority"""


def sales_by_customer(order_on="TRUE", one_join=False, with_paid=True):
    pay = "LEFT JOIN pays p ON p.user_id = c.c_custkey" if one_join else ""
    paid = "ROUND(SUM(p.amount), 2)" if one_join else "ROUND(MAX(COALESCE(pref.v, 0)), 2)"
    paid = f"{paid} AS paid_calc," if with_paid else ""
    return f"""WITH ords AS (
      SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
      FROM orders),
    pays AS (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events
             WHERE event_type = 'purchase')
    SELECT c.c_custkey, c.c_name, c.c_nationkey, COUNT(DISTINCT o.o_orderkey) AS n_orders,
           ROUND(COALESCE(SUM(o.amount), 0), 2) AS revenue_calc, {paid}
           ROUND(MAX(COALESCE(pref.v, 0)), 2) AS paid_ref,
           ROUND(MAX(COALESCE(oref.v, 0)), 2) AS revenue_ref
    FROM customer c
    LEFT JOIN ords o ON o.o_custkey = c.c_custkey AND {order_on}
    {pay}
    LEFT JOIN (SELECT user_id AS k, SUM(amount) AS v FROM pays GROUP BY 1) pref ON pref.k = c.c_custkey
    LEFT JOIN (SELECT o_custkey AS k, SUM(amount) AS v FROM ords GROUP BY 1) oref ON oref.k = c.c_custkey
    GROUP BY c.c_custkey, c.c_name, c.c_nationkey"""


def nation_profile(supplier_on="n.n_nationkey", one_join=False):
    extra = "LEFT JOIN sup s ON s.s_nationkey = n.n_nationkey" if one_join else ""
    calc = "COALESCE(SUM(s.balance), 0)" if one_join else "MAX(COALESCE(calc.v, 0))"
    return f"""WITH sup AS (SELECT s_nationkey, CAST(s_acctbal AS DECIMAL(18,2)) AS balance FROM supplier)
    SELECT n.n_nationkey, n.n_name, n.n_regionkey, COUNT(DISTINCT c.c_custkey) AS n_customers,
           MAX(CAST(c.c_acctbal AS DECIMAL(18,2))) AS largest_balance,
           ROUND({calc}, 1) AS balance_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 1) AS balance_ref
    FROM nation n
    LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    {extra}
    LEFT JOIN (SELECT s_nationkey AS k, SUM(balance) AS v FROM sup GROUP BY 1) calc ON calc.k = {supplier_on}
    LEFT JOIN (SELECT s_nationkey AS k, SUM(balance) AS v FROM sup GROUP BY 1) ref ON ref.k = n.n_nationkey
    GROUP BY n.n_nationkey, n.n_name, n.n_regionkey"""


def supplier_season(order_on="o.o_orderkey = l.l_orderkey", first="l.l_linenumber = 1"):
    return f"""
    SELECT CAST(YEAR(o.o_orderdate) AS VARCHAR) || ':' || CAST(l.l_suppkey AS VARCHAR) AS row_key,
           YEAR(o.o_orderdate) AS o_year, l.l_suppkey, s.s_name, COUNT(*) AS n_lines,
           SUM(CASE WHEN {first} THEN 1 ELSE 0 END) AS firsts_calc,
           SUM(CASE WHEN l.l_linenumber <= 3 THEN 1 ELSE 0 END) AS early_lines,
           CAST((200 * SUM(l.l_linenumber) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS average_line,
           MAX(COALESCE(ref.v, 0)) AS firsts_ref
    FROM lineitem l
    JOIN orders o ON {order_on}
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    LEFT JOIN (SELECT YEAR(o2.o_orderdate) AS y, l2.l_suppkey AS k, COUNT(*) AS v
               FROM lineitem l2 JOIN orders o2 ON o2.o_orderkey = l2.l_orderkey
               WHERE l2.l_linenumber = 1 GROUP BY 1, 2) ref
      ON ref.y = YEAR(o.o_orderdate) AND ref.k = l.l_suppkey
    GROUP BY 1, 2, 3, 4"""


def part_margin(order_on="o.o_orderkey = l.l_orderkey", amount="l.net"):
    return f"""WITH {LINES}
    SELECT CAST(l.l_partkey AS VARCHAR) || ':' || CAST(l.l_suppkey AS VARCHAR) AS row_key,
           l.l_partkey, l.l_suppkey, ROUND(SUM(l.quantity), 2) AS total_qty,
           ROUND(SUM({amount}), 2) AS net_revenue_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 2) AS net_revenue_ref
    FROM lines l
    JOIN orders o ON {order_on} AND o.o_orderstatus = 'O'
    LEFT JOIN (SELECT l2.l_partkey AS p, l2.l_suppkey AS s, SUM(l2.net) AS v
               FROM lines l2 JOIN orders o2 ON o2.o_orderkey = l2.l_orderkey
               WHERE o2.o_orderstatus = 'O' GROUP BY 1, 2) ref
      ON ref.p = l.l_partkey AND ref.s = l.l_suppkey
    GROUP BY 1, 2, 3"""


def item_sales(item_on="p.p_partkey = l.l_partkey", period="d.d_year = 1998"):
    return f"""WITH {LINES},
    dates AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d_day,
                     YEAR(l_shipdate) AS d_year, MONTH(l_shipdate) AS d_month FROM lineitem)
    SELECT p.p_partkey, p.p_name, p.p_brand, COUNT(DISTINCT l.l_orderkey) AS n_orders,
           ROUND(SUM(l.quantity), 2) AS units_calc, ROUND(SUM(l.net), 2) AS sales_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 2) AS sales_ref
    FROM lines l
    JOIN part p ON {item_on}
    JOIN dates d ON d.d_day = CAST(l.l_shipdate AS DATE)
    LEFT JOIN (SELECT l2.l_partkey AS k, SUM(l2.net) AS v FROM lines l2
               JOIN dates d2 ON d2.d_day = CAST(l2.l_shipdate AS DATE)
               WHERE d2.d_year = 1998 GROUP BY 1) ref ON ref.k = p.p_partkey
    WHERE {period}
    GROUP BY p.p_partkey, p.p_name, p.p_brand"""


def supplier_stats(supplier_on="s.s_suppkey = l.l_suppkey", where="TRUE"):
    return f"""
    SELECT s.s_suppkey, s.s_name, s.s_nationkey, COUNT(*) AS n_lines_calc,
           SUM(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END) AS n_kept,
           COUNT(DISTINCT l.l_partkey) AS n_parts, MAX(COALESCE(ref.v, 0)) AS n_lines_ref
    FROM lineitem l
    JOIN supplier s ON {supplier_on}
    LEFT JOIN (SELECT l_suppkey AS k, COUNT(*) AS v FROM lineitem GROUP BY 1) ref ON ref.k = s.s_suppkey
    WHERE {where}
    GROUP BY s.s_suppkey, s.s_name, s.s_nationkey"""


def order_stats(where="TRUE", returns="LEFT JOIN"):
    return f"""WITH settled AS (
      SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')),
    returned AS (
      SELECT l_orderkey AS k, COUNT(*) AS n,
             CAST((200 * SUM(CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) + COUNT(*))
                  // (2 * COUNT(*)) AS DOUBLE) / 10000 AS average_discount
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    counts AS (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, r.average_discount,
           r.n AS n_returned, COALESCE(c.n, 0) AS n_lines_calc, COALESCE(ref.n, 0) AS n_lines_ref
    FROM settled o
    {returns} returned r ON r.k = o.o_orderkey
    LEFT JOIN counts c ON c.k = o.o_orderkey
    LEFT JOIN counts ref ON ref.k = o.o_orderkey
    WHERE {where}"""


def supplier_sales(line_on="l.l_suppkey = s.s_suppkey", extra=""):
    return f"""WITH {LINES},
    placed AS (SELECT s_suppkey, s_name AS supplier_name, n_name AS nation, r_name AS region
               FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
               LEFT JOIN region ON r_regionkey = n_regionkey)
    SELECT s.s_suppkey, s.supplier_name, s.nation, s.region, COUNT(*) AS n_lines,
           ROUND(SUM(l.quantity), 2) AS units_calc,
           ROUND(COALESCE(SUM(l.net), 0), 2) AS revenue_calc,
           ROUND(MAX(COALESCE(ref.v, 0)), 2) AS revenue_ref
    FROM placed s
    LEFT JOIN lines l ON {line_on}
    {extra}
    LEFT JOIN (SELECT l_suppkey AS k, SUM(net) AS v FROM lines GROUP BY 1) ref ON ref.k = s.s_suppkey
    GROUP BY s.s_suppkey, s.supplier_name, s.nation, s.region"""


def region_stats(customer_on="c.r_regionkey = r.r_regionkey"):
    return f"""WITH placed AS (
      SELECT c_custkey, c_nationkey, r_regionkey, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT r.r_regionkey, r.r_name, m.s_name AS manager,
           COUNT(DISTINCT c.c_custkey) AS n_customers_calc,
           SUM(CASE WHEN c.balance >= 0 THEN 1 ELSE 0 END) AS n_active_calc,
           MAX(COALESCE(ref.v, 0)) AS n_customers_ref
    FROM region r
    LEFT JOIN supplier m ON m.s_suppkey = r.r_regionkey
    LEFT JOIN placed c ON {customer_on}
    LEFT JOIN (SELECT n_regionkey AS k, COUNT(*) AS v FROM customer
               JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) ref ON ref.k = r.r_regionkey
    GROUP BY r.r_regionkey, r.r_name, m.s_name"""


REPORTS = {f.__name__: f for f in (
    customer_revenue, order_value, order_performance, sales_by_customer, nation_profile,
    supplier_season, part_margin, item_sales, supplier_stats, order_stats, supplier_sales,
    region_stats)}

_EVENTS = "LEFT JOIN events e ON e.user_id = {}"
# defect id -> (report, arguments of its SQL, columns the trap lacks)
TRAPS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "CH01": ("customer_revenue", dict(line_on="l.l_partkey = o.o_orderkey"), ()),
    "CH02": ("customer_revenue", dict(extra=_EVENTS.format("c.c_custkey")), ()),
    "NW01": ("order_value", dict(part_on="p.p_partkey = l.l_suppkey", with_net_ref=False),
             ("net_value_ref",)),
    "NW02": ("order_value", dict(net="l.gross"), ()),
    "SK01": ("order_performance", dict(extra=_EVENTS.format("o.o_custkey")), ()),
    "SK02": ("order_performance", dict(line_on="l.l_suppkey = o.o_custkey"), ()),
    "SK03": ("order_performance", dict(join="JOIN"), ()),
    "CM01": ("sales_by_customer", dict(one_join=True), ()),
    "CM02": ("sales_by_customer", dict(order_on="o.o_orderstatus = 'F'", with_paid=False),
             ("paid_calc",)),
    "WO01": ("nation_profile", dict(one_join=True), ()),
    "WO02": ("nation_profile", dict(supplier_on="n.n_regionkey"), ()),
    "F101": ("supplier_season", dict(order_on="MONTH(o.o_orderdate) = l.l_orderkey"), ()),
    "F102": ("supplier_season", dict(first="l.l_linenumber >= 1"), ()),
    "TP01": ("part_margin", dict(amount="l.gross"), ()),
    "TP02": ("part_margin", dict(order_on="o.o_custkey = l.l_orderkey"), ()),
    "TD01": ("item_sales", dict(period="d.d_month = 1"), ()),
    "TD02": ("item_sales", dict(item_on="p.p_partkey = l.l_suppkey"), ()),
    "OF01": ("supplier_stats", dict(supplier_on="s.s_nationkey = l.l_suppkey"), ()),
    "OF02": ("supplier_stats", dict(where="l.l_returnflag = 'R'"), ()),
    "IM01": ("order_stats", dict(where="o.o_orderstatus = 'F'"), ()),
    "IM02": ("order_stats", dict(returns="JOIN"), ()),
    "ZT01": ("supplier_sales", dict(line_on="l.l_orderkey = s.s_suppkey"), ()),
    "ZT02": ("supplier_sales", dict(extra=_EVENTS.format("s.s_suppkey")), ()),
    "ZS01": ("region_stats", dict(customer_on="c.c_nationkey = r.r_regionkey"), ()),
    "ZS02": ("region_stats", dict(customer_on="c.r_regionkey = r.r_regionkey AND c.balance < 0"), ()),
}
# defect id -> (calculated column, reference column) or the source a missing row is looked up in
GOLD: dict[str, tuple[str, str] | str] = {
    "CH01": ("revenue_calc", "revenue_ref"), "CH02": ("revenue_calc", "revenue_ref"),
    "NW01": ("list_value", "list_value_ref"), "NW02": ("net_value", "net_value_ref"),
    "SK01": ("revenue_calc", "revenue_ref"), "SK02": ("revenue_calc", "revenue_ref"),
    "SK03": "SELECT o_orderkey AS k FROM orders",
    "CM01": ("paid_calc", "paid_ref"), "CM02": ("revenue_calc", "revenue_ref"),
    "WO01": ("balance_calc", "balance_ref"), "WO02": ("balance_calc", "balance_ref"),
    "F101": ("firsts_calc", "firsts_ref"), "F102": ("firsts_calc", "firsts_ref"),
    "TP01": ("net_revenue_calc", "net_revenue_ref"), "TP02": ("net_revenue_calc", "net_revenue_ref"),
    "TD01": ("sales_calc", "sales_ref"), "TD02": ("sales_calc", "sales_ref"),
    "OF01": ("n_lines_calc", "n_lines_ref"), "OF02": ("n_lines_calc", "n_lines_ref"),
    "IM01": "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "IM02": "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "ZT01": ("revenue_calc", "revenue_ref"), "ZT02": ("revenue_calc", "revenue_ref"),
    "ZS01": ("n_customers_calc", "n_customers_ref"), "ZS02": ("n_customers_calc", "n_customers_ref"),
}
# defect id -> the column the diff compares
PRIMARY = {d: (g[0] if isinstance(g, tuple) else "") for d, g in GOLD.items()} | {
    "SK03": "revenue_calc", "IM01": "n_lines_calc", "IM02": "average_discount", "ZT01": "units_calc",
}


def clean_sql(report: str) -> str:
    return REPORTS[report]()


def trap_sql(defect: str) -> str:
    report, arguments, _ = TRAPS[defect]
    return REPORTS[report](**arguments)


def trap_columns(defect: str) -> dict[str, str]:
    report, _, dropped = TRAPS[defect]
    return {c: t for c, t in COLUMNS[report].items() if c not in dropped}


def typed(body: str, columns: dict[str, str]) -> str:
    """Cast every output column to the type the comparison expects."""
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    return f"SELECT {casts} FROM ({body}) typed_rows"


def diff_sql(defect: str, column: str | None = None) -> str:
    """Null-safe full outer diff of trap and clean report."""
    report = TRAPS[defect][0]
    pk, col = PK[report], column or PRIMARY[defect]
    return f"""WITH f AS (SELECT *, TRUE AS here FROM ({trap_sql(defect)}) a),
    t AS (SELECT *, TRUE AS here FROM ({clean_sql(report)}) b)
    SELECT CAST(COALESCE(f.{pk}, t.{pk}) AS VARCHAR) AS flagged_pk,
           CASE WHEN f.here IS NULL THEN 'missing' WHEN t.here IS NULL THEN 'extra'
                ELSE 'changed' END AS side,
           CAST(f.{col} AS DOUBLE) AS reported, CAST(t.{col} AS DOUBLE) AS expected
    FROM f FULL JOIN t ON f.{pk} IS NOT DISTINCT FROM t.{pk}
    WHERE f.here IS NULL OR t.here IS NULL OR f.{col} IS DISTINCT FROM t.{col}"""


def gold_on(body: str, defect: str) -> str:
    """The diagnostic of a defect run over a report given as SQL."""
    pk, gold = PK[TRAPS[defect][0]], GOLD[defect]
    if isinstance(gold, str):
        return f"""SELECT CAST(s.k AS VARCHAR) AS flagged_pk FROM ({gold}) s
        LEFT JOIN ({body}) r ON r.{pk} = s.k WHERE r.{pk} IS NULL"""
    return f"""SELECT CAST({pk} AS VARCHAR) AS flagged_pk FROM ({body}) r
    WHERE {gold[0]} IS DISTINCT FROM {gold[1]}"""


def gold_sql(defect: str) -> str:
    return gold_on(trap_sql(defect), defect)
