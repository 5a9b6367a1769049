"""The twenty-five defects: how each pipeline's last step can go wrong."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from recon.plans import reports as r
from recon.plans.spec import Defect, Frames


def _month_one(f: Frames):
    return r.item_sales(f, period=("month 1", F.col("d_month") == 1))


def _any_line_first(f: Frames):
    return r.supplier_season(f, first_line=F.col("l_linenumber") >= 1)


_SAME = "mismatch"
_GONE = "missing"

# Ids, pipelines, kinds, dimensions, categories and severities of the defects.
_ROWS = (
    # id, pipeline, kind, dimension, category, severity, columns, build, check, description
    ("CH01", "customer_revenue", "wrong_join_key", "consistency", "join", "high",
     ("revenue_calc", "revenue_ref"), partial(r.customer_revenue, line_key="l_partkey"),
     (_SAME, "revenue_calc", "revenue_ref"),
     "order lines are attached by part key where the order key belongs"),
    ("CH02", "customer_revenue", "missing_dedup", "consistency", "aggregation", "high",
     ("revenue_calc", "revenue_ref"), partial(r.customer_revenue, with_events=True),
     (_SAME, "revenue_calc", "revenue_ref"),
     "the event log is joined without deduplication, so revenue counts once per event"),
    ("NW01", "order_value", "wrong_join_key", "consistency", "join", "high",
     ("list_value", "list_value_ref"),
     partial(r.order_value, line_part="l_suppkey", with_net_ref=False),
     (_SAME, "list_value", "list_value_ref"),
     "the part catalogue is matched by supplier key, so list prices come from other parts"),
    ("NW02", "order_value", "formula", "accuracy", "calculation", "high",
     ("net_value", "net_value_ref"), partial(r.order_value, net="gross"),
     (_SAME, "net_value", "net_value_ref"),
     "net value is the gross sum, the discount is left out"),
    ("SK01", "order_performance", "missing_dedup", "consistency", "aggregation", "high",
     ("revenue_calc", "revenue_ref"), partial(r.order_performance, with_events=True),
     (_SAME, "revenue_calc", "revenue_ref"),
     "the customer's events are joined in, so each amount counts once per event"),
    ("SK02", "order_performance", "wrong_join_key", "consistency", "join", "high",
     ("revenue_calc", "revenue_ref"),
     partial(r.order_performance, order_key="o_custkey", line_key="l_suppkey"),
     (_SAME, "revenue_calc", "revenue_ref"),
     "lines are attached by supplier key against the customer key"),
    ("SK03", "order_performance", "inner_vs_left", "completeness", "join", "medium",
     ("revenue_calc", "revenue_ref"), partial(r.order_performance, how="inner"),
     (_GONE, "stg_orders"),
     "inner joins drop the orders without lines"),
    ("CM01", "sales_by_customer", "double_count_fanout", "consistency", "aggregation", "high",
     ("paid_calc", "paid_ref"), partial(r.sales_by_customer, one_join=True),
     (_SAME, "paid_calc", "paid_ref"),
     "orders and purchases, two independent children, share one grouped join"),
    ("CM02", "sales_by_customer", "filter_drift", "accuracy", "filter", "medium",
     ("revenue_calc", "revenue_ref"), partial(r.sales_by_customer, status="F", with_paid=False),
     (_SAME, "revenue_calc", "revenue_ref"),
     "only finished orders are summed, revenue of the others is lost"),
    ("WO01", "nation_profile", "double_count_fanout", "consistency", "aggregation", "high",
     ("balance_calc",), partial(r.nation_profile, one_join=True),
     (_SAME, "balance_calc", "balance_ref"),
     "customers and suppliers share one grouped join, so balances count once per customer"),
    ("WO02", "nation_profile", "wrong_join_key", "consistency", "join", "high",
     ("balance_calc",), partial(r.nation_profile, supplier_on="n_regionkey"),
     (_SAME, "balance_calc", "balance_ref"),
     "suppliers are matched by the nation's region key"),
    ("F101", "supplier_season", "wrong_join_key", "consistency", "join", "high",
     ("firsts_calc", "n_lines"), partial(r.supplier_season, on_month=True),
     (_SAME, "firsts_calc", "firsts_ref"),
     "orders are matched by month against the order key, so lines land in other years"),
    ("F102", "supplier_season", "formula", "accuracy", "calculation", "high",
     ("firsts_calc", "firsts_ref"), _any_line_first,
     (_SAME, "firsts_calc", "firsts_ref"),
     "every line number from one up counts as a first line"),
    ("TP01", "part_margin", "formula", "accuracy", "calculation", "high",
     ("net_revenue_calc", "net_revenue_ref"), partial(r.part_margin, amount="gross"),
     (_SAME, "net_revenue_calc", "net_revenue_ref"),
     "net revenue sums the extended price without the discount"),
    ("TP02", "part_margin", "wrong_join_key", "consistency", "join", "high",
     ("net_revenue_calc", "net_revenue_ref"), partial(r.part_margin, order_key="o_custkey"),
     (_SAME, "net_revenue_calc", "net_revenue_ref"),
     "open orders are matched by customer key against the line's order key"),
    ("TD01", "item_sales", "time_boundary", "timeliness", "filter", "medium",
     ("sales_calc", "sales_ref"), _month_one,
     (_SAME, "sales_calc", "sales_ref"),
     "the year condition is replaced by the month of January"),
    ("TD02", "item_sales", "wrong_join_key", "consistency", "join", "high",
     ("sales_calc", "sales_ref"), partial(r.item_sales, item_key="l_suppkey"),
     (_SAME, "sales_calc", "sales_ref"),
     "the part dimension is matched by supplier key"),
    ("OF01", "supplier_stats", "wrong_join_key", "consistency", "join", "high",
     ("n_lines_calc", "n_lines_ref"), partial(r.supplier_stats, supplier_key="s_nationkey"),
     (_SAME, "n_lines_calc", "n_lines_ref"),
     "lines are matched by the supplier's nation key"),
    ("OF02", "supplier_stats", "filter_drift", "accuracy", "filter", "medium",
     ("n_lines_calc", "n_lines_ref"), partial(r.supplier_stats, flag="R"),
     (_SAME, "n_lines_calc", "n_lines_ref"),
     "only returned lines are counted"),
    ("IM01", "order_stats", "filter_drift", "completeness", "filter", "medium",
     ("n_lines_calc", "n_lines_ref"), partial(r.order_stats, status="F"),
     (_GONE, "stg_orders"),
     "only finished orders are kept, every open order is missing"),
    ("IM02", "order_stats", "inner_vs_left", "completeness", "join", "medium",
     ("average_discount", "n_lines_calc"), partial(r.order_stats, returns="inner"),
     (_GONE, "stg_orders"),
     "orders without a returned line disappear through an inner join"),
    ("ZT01", "supplier_sales", "wrong_join_key", "consistency", "join", "high",
     ("units_calc", "revenue_calc"), partial(r.supplier_sales, line_key="l_orderkey"),
     (_SAME, "revenue_calc", "revenue_ref"),
     "lines are attached by order key against the supplier key"),
    ("ZT02", "supplier_sales", "missing_dedup", "consistency", "aggregation", "high",
     ("revenue_calc", "revenue_ref"), partial(r.supplier_sales, with_events=True),
     (_SAME, "revenue_calc", "revenue_ref"),
     "the event log is joined without deduplication, so sales count once per event"),
    ("ZS01", "region_stats", "wrong_join_key", "consistency", "join", "high",
     ("n_customers_calc", "n_customers_ref"), partial(r.region_stats, customer_key="c_nationkey"),
     (_SAME, "n_customers_calc", "n_customers_ref"),
     "customers are attached by nation key against the region key"),
    ("ZS02", "region_stats", "filter_drift", "completeness", "filter", "medium",
     ("n_customers_calc", "n_customers_ref"), partial(r.region_stats, only_negative=True),
     (_SAME, "n_customers_calc", "n_customers_ref"),
     "only customers with a negative balance are counted"),
)

DEFECTS: tuple[Defect, ...] = tuple(
    Defect(
        defect_id=i, pipeline_id=p, kind=k, dimension=d, category=c, severity=s,
        columns=cols, build=b, check=ch, description=text,
    )
    for i, p, k, d, c, s, cols, b, ch, text in _ROWS
)
DEFECTS_BY_ID: dict[str, Defect] = {d.defect_id: d for d in DEFECTS}


def defects_for_pipeline(pipeline_id: str) -> list[Defect]:
    return [d for d in DEFECTS if d.pipeline_id == pipeline_id]
