"""The twelve reporting pipelines.

Every last step takes keyword arguments that bend it; with the defaults it is the healthy
report, and ``recon.plans.defects`` binds the arguments that spoil it. Child tables are reduced
to one row per join key before they are joined, so a join never has more output rows than its
larger input, whatever key it is made on. A ``*_ref`` column is asked for apart from the value it
checks; where both turn out to be the same grouping, ``recon.plans.staging`` computes them in one pass.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.functions.exact import (
    discounted, mean, money, rate, repeated, times, total, total_or_zero,
)
from recon.operators.joins import salted_lookup
from recon.plans.spec import Frames, Pipeline, Projection, Step, keyed
from recon.plans.staging import Grouping, Input, beside, is_clustered, resolve, step_input

# Fixed value: the year the item report covers.
ITEM_YEAR = 1998
PURCHASE = "purchase"


_lines = Projection("lineitem", lambda: {
    **{c: F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")},
    "ship_day": F.to_date("l_shipdate"),
    "quantity": money("l_quantity"),
    "gross": money("l_extendedprice"),
    "discount": rate("l_discount"),
    "net": discounted("l_extendedprice", "l_discount"),
}, cluster=("l_orderkey",))

_orders = Projection("orders", lambda: {
    **{c: F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")},
    "o_orderdate": F.to_date("o_orderdate"),
    "order_total": money("o_totalprice"),
}, key=("o_orderkey",))


def _count(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


STG_LINES = Step("stg_lines", "L0", "staging of order lines with gross and net amount", _lines)
STG_ORDERS = Step("stg_orders", "L0", "staging of orders", _orders)
LINES = step_input(STG_LINES)
EVENTS = Input("events", lambda f: f["events"])


def _by(kind: str, column: str) -> tuple[str, Column]:
    return kind, F.col(column)


def _number() -> tuple[str, Column]:
    return "count", F.lit(1)


def _copies(f: Frames, of: Input, key: str, alias: str) -> DataFrame:
    """How many rows each key has: stands in for a child table that only multiplies rows."""
    return beside(f, Grouping(of, (key,), {"copies": _number()})).withColumnRenamed(key, alias)


# customer_revenue -------------------------------------------------------------------------

def _ordered_lines(line_key: str) -> Input:
    def build(f: Frames) -> DataFrame:
        lines = beside(f, Grouping(LINES, (line_key,), {"net": _by("sum", "net")}))
        orders = resolve(f, STG_ORDERS).select("o_orderkey", "o_custkey")
        return orders.join(lines, F.col("o_orderkey") == F.col(line_key), "left")

    return Input(f"orders with lines by {line_key}", build)


def customer_revenue(f: Frames, line_key: str = "l_orderkey", with_events: bool = False) -> DataFrame:
    calc = Grouping(_ordered_lines(line_key), ("o_custkey",),
                    {"n_orders": _by("distinct", "o_orderkey"), "net": _by("sum", "net")})
    ref = Grouping(_ordered_lines("l_orderkey"), ("o_custkey",), {"ref_net": _by("sum", "net")})
    revenue = beside(f, calc, ref)
    if with_events:
        revenue = revenue.join(_copies(f, EVENTS, "user_id", "user_id"), F.col("o_custkey") == F.col("user_id"), "left").withColumn(
            "net", F.col("net") * times(F.col("copies"))
        )
    return (
        f["customer"].join(revenue, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            "c_custkey", "c_name", "c_mktsegment",
            _count(F.col("n_orders")).alias("n_orders"),
            total_or_zero(F.col("net")).alias("revenue_calc"),
            total_or_zero(F.col("ref_net")).alias("revenue_ref"),
        )
    )


# order_value ------------------------------------------------------------------------------

_parts = Projection("part", lambda: {
    "p_partkey": F.col("p_partkey"), "p_name": F.col("p_name"), "p_brand": F.col("p_brand"),
    "list_price": money("p_retailprice"),
}, key=("p_partkey",))
STG_PARTS = Step("stg_parts", "L0", "staging of parts with list price", _parts)


def _priced_lines(line_part: str) -> Input:
    def build(f: Frames) -> DataFrame:
        parts = resolve(f, STG_PARTS).select("p_partkey", "list_price")
        lines = resolve(f, STG_LINES).join(parts, F.col(line_part) == F.col("p_partkey"))
        # No order is hot then, and rows are smaller than the sums of one line each that they would be combined to.
        return lines.repartition("l_orderkey") if is_clustered(f, STG_LINES) else lines

    return Input(f"lines priced by {line_part}", build)


def order_value(
    f: Frames, line_part: str = "l_partkey", net: str = "net", with_net_ref: bool = True
) -> DataFrame:
    listed = ("sum", (F.col("list_price") * F.col("quantity")).cast("decimal(28,4)"))
    calc = Grouping(_priced_lines(line_part), ("l_orderkey",), {
        "n_lines": _number(), "gross": _by("sum", "gross"), "net": _by("sum", "net"), "listed": listed})
    refs = [Grouping(_priced_lines("l_partkey"), ("l_orderkey",), {"ref_listed": listed})]
    if with_net_ref:
        refs.append(Grouping(LINES, ("l_orderkey",), {"ref_net": _by("sum", "net")}))
    out = f["stg_orders"].join(beside(f, calc, *refs), F.col("o_orderkey") == F.col("l_orderkey"))
    columns = [
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "n_lines",
        total(F.col("gross")).alias("gross_value"),
        total_or_zero(F.col(net)).alias("net_value"),
    ]
    if with_net_ref:
        columns.append(total_or_zero(F.col("ref_net")).alias("net_value_ref"))
    columns += [
        total(F.col("listed")).alias("list_value"),
        total_or_zero(F.col("ref_listed")).alias("list_value_ref"),
    ]
    return out.select(*columns)


# order_performance ------------------------------------------------------------------------

_suppliers = Projection("supplier", lambda: {
    "s_suppkey": F.col("s_suppkey"), "s_nationkey": F.col("s_nationkey"), "unnamed": F.col("s_name").isNull(),
    "balance": money("s_acctbal"),
}, key=("s_suppkey",))
STG_SUPPLIERS = Step("stg_suppliers", "L0", "staging of suppliers", _suppliers)


def _supplied_lines(how: str) -> Input:
    def build(f: Frames) -> DataFrame:
        suppliers = resolve(f, STG_SUPPLIERS).select("s_suppkey")
        return resolve(f, STG_LINES).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), how)

    return Input(f"lines and suppliers, {how}", build)


def order_performance(
    f: Frames,
    order_key: str = "o_orderkey",
    line_key: str = "l_orderkey",
    how: str = "left",
    with_events: bool = False,
) -> DataFrame:
    orders = f["stg_orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    supplied = Grouping(_supplied_lines(how), (line_key,),
                        {"n_suppliers": _by("distinct", "s_suppkey"), "net": _by("sum", "net")})
    lines = beside(f, supplied).withColumnRenamed(line_key, "line_key")
    if order_key == "o_orderkey":
        calc = orders.join(lines, F.col(order_key) == F.col("line_key"), how)
    else:
        calc = salted_lookup(orders, lines, order_key, "line_key", F.col("o_orderkey"), how)
    if with_events:
        copies = _copies(f, EVENTS, "user_id", "user_id")
        calc = salted_lookup(calc, copies, "o_custkey", "user_id", F.col("o_orderkey"))
        calc = calc.withColumn("net", F.col("net") * times(F.col("copies")))
    ref = beside(f, Grouping(LINES, ("l_orderkey",), {"ref_net": _by("sum", "net")}))
    return calc.join(ref, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        _count(F.col("n_suppliers")).alias("n_suppliers"),
        total_or_zero(F.col("net")).alias("revenue_calc"),
        total_or_zero(F.col("ref_net")).alias("revenue_ref"),
    )


# sales_by_customer ------------------------------------------------------------------------

_purchases = Projection("events", lambda: {
    "event_id": F.col("event_id"), "user_id": F.col("user_id"), "amount": money("value"),
}, where=lambda: F.col("event_type") == PURCHASE, carry=("event_type",))
STG_PURCHASES = Step("stg_purchases", "L0", "staging of purchase events", _purchases)


def sales_by_customer(
    f: Frames, status: str | None = None, one_join: bool = False, with_paid: bool = True
) -> DataFrame:
    orders, key = step_input(STG_ORDERS), ("o_custkey",)
    calc = Grouping(orders, key, {
        "n_orders": _by("distinct", "o_orderkey"), "order_rows": _number(), "revenue": _by("sum", "order_total"),
    }, (f"status {status}", F.col("o_orderstatus") == status) if status else None)
    # The reference covers every customer with orders, the other value perhaps fewer.
    ref = Grouping(orders, key, {"ref_revenue": _by("sum", "order_total")})
    paid = beside(f, Grouping(step_input(STG_PURCHASES), ("user_id",), {"purchases": _number(), "paid": _by("sum", "amount")}))
    out = (
        f["customer"].join(beside(f, ref, calc), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(paid, F.col("c_custkey") == F.col("user_id"), "left")
    )
    revenue, paid_calc = F.col("revenue"), total_or_zero(F.col("paid"))
    if one_join:
        revenue = revenue * times(F.col("purchases"))
        paid_calc = total(F.col("paid") * times(F.col("order_rows")))
    columns = [
        "c_custkey", "c_name", "c_nationkey",
        _count(F.col("n_orders")).alias("n_orders"),
        total_or_zero(revenue).alias("revenue_calc"),
    ]
    if with_paid:
        columns.append(paid_calc.alias("paid_calc"))
    columns += [
        total_or_zero(F.col("paid")).alias("paid_ref"),
        total_or_zero(F.col("ref_revenue")).alias("revenue_ref"),
    ]
    return out.select(*columns)


# nation_profile ---------------------------------------------------------------------------

_customers = Projection("customer", lambda: {
    "c_custkey": F.col("c_custkey"), "c_nationkey": F.col("c_nationkey"), "balance": money("c_acctbal"),
}, key=("c_custkey",))
STG_CUSTOMERS = Step("stg_customers", "L0", "staging of customers", _customers)


def nation_profile(f: Frames, supplier_on: str = "n_nationkey", one_join: bool = False) -> DataFrame:
    def tenth(amount: Column) -> Column:
        return F.round(F.coalesce(amount, F.lit(0).cast("decimal(18,2)")), 1).cast("decimal(38,1)")

    customers = beside(f, Grouping(step_input(STG_CUSTOMERS), ("c_nationkey",), {
        "n_customers": _by("distinct", "c_custkey"), "customer_rows": _number(), "largest": _by("max", "balance"),
    })).withColumnRenamed("c_nationkey", "n_nationkey")
    by_nation = Grouping(step_input(STG_SUPPLIERS), ("s_nationkey",), {"supplied": _by("sum", "balance")})
    balances = beside(f, by_nation).withColumnRenamed("s_nationkey", "supplier_nation")
    ref = beside(f, by_nation).toDF("n_nationkey", "ref_supplied")
    out = (
        f["nation"].join(customers, "n_nationkey", "left")
        .join(balances, F.col(supplier_on) == F.col("supplier_nation"), "left")
        .join(ref, "n_nationkey", "left")
    )
    supplied = F.col("supplied")
    if one_join:
        supplied = supplied * times(F.col("customer_rows"))
    return out.select(
        "n_nationkey", "n_name", "n_regionkey",
        _count(F.col("n_customers")).alias("n_customers"),
        F.col("largest").alias("largest_balance"),
        tenth(supplied).alias("balance_calc"),
        tenth(F.col("ref_supplied")).alias("balance_ref"),
    )


# supplier_season --------------------------------------------------------------------------

_dated_orders = Projection("orders", lambda: {
    "o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"),
    "o_year": F.year("o_orderdate"), "o_month": F.month("o_orderdate"),
}, key=("o_orderkey",))
STG_DATED_ORDERS = Step("stg_orders", "L0", "staging of orders with year and month", _dated_orders)


def _dated_lines(on_month: bool) -> Input:
    def build(f: Frames) -> DataFrame:
        lines = resolve(f, STG_LINES).select("l_orderkey", "l_suppkey", "l_linenumber")
        if on_month:
            # At most twelve months times the calendar years on file, so this side is broadcast.
            months = beside(f, Grouping(step_input(STG_DATED_ORDERS), ("o_month", "o_year"), {"copies": _number()}))
            return lines.join(months.hint("broadcast"), F.col("l_orderkey") == F.col("o_month"))
        years = resolve(f, STG_DATED_ORDERS).select("o_orderkey", "o_year")
        return lines.join(years, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("copies", F.lit(1).cast("bigint"))

    return Input("lines dated by month" if on_month else "lines dated by order", build)


def supplier_season(
    f: Frames, on_month: bool = False, first_line: Column | None = None
) -> DataFrame:
    keys = ("o_year", "l_suppkey")
    number, copies = F.col("l_linenumber"), F.col("copies")
    is_first = F.when(number == 1 if first_line is None else first_line, 1).otherwise(0)
    calc = Grouping(_dated_lines(on_month), keys, {
        "n_lines": _by("sum", "copies"),
        "firsts_calc": ("sum", is_first * copies),
        "early_lines": ("sum", F.when(number <= 3, 1).otherwise(0) * copies),
        "numbers": ("sum", number * copies),
    })
    ref = Grouping(_dated_lines(False), keys, {"ref_firsts": _number()}, ("first line", number == 1))
    names = f["supplier"].select("s_suppkey", "s_name")
    out = beside(f, calc, ref).join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    return keyed(
        out.select(
            "o_year", "l_suppkey", "s_name", "n_lines", "firsts_calc", "early_lines",
            mean(F.col("numbers"), F.col("n_lines"), 2).alias("average_line"),
            _count(F.col("ref_firsts")).alias("firsts_ref"),
        ),
        keys,
    )


# part_margin ------------------------------------------------------------------------------

_open_orders = Projection("orders", lambda: {
    "o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "o_orderstatus": F.col("o_orderstatus"),
}, where=lambda: F.col("o_orderstatus") == "O", key=("o_orderkey",))
STG_OPEN_ORDERS = Step("stg_orders", "L0", "staging of open orders", _open_orders)


def _open_lines(order_key: str) -> Input:
    """Lines of open orders, each once, with the number of open orders it belongs to."""

    def build(f: Frames) -> DataFrame:
        lines = resolve(f, STG_LINES).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "gross", "net")
        copies = _copies(f, step_input(STG_OPEN_ORDERS), order_key, "order_key").select(
            "order_key", F.col("copies").cast("decimal(9,0)").alias("copies"))
        if order_key == "o_orderkey" or is_clustered(f, STG_LINES):
            return lines.join(copies, F.col("l_orderkey") == F.col("order_key"))
        spread = F.struct("l_partkey", "l_suppkey", "l_linenumber")
        return salted_lookup(lines, copies, "l_orderkey", "order_key", spread, "inner")

    return Input(f"lines of open orders by {order_key}", build)


def part_margin(f: Frames, order_key: str = "o_orderkey", amount: str = "net") -> DataFrame:
    keys = ("l_partkey", "l_suppkey")
    calc = Grouping(_open_lines(order_key), keys, {
        "quantity": ("sum", F.col("quantity") * F.col("copies")), "amount": ("sum", F.col(amount) * F.col("copies"))})
    ref = Grouping(_open_lines("o_orderkey"), keys, {"ref_net": _by("sum", "net")})
    out = beside(f, calc, ref)
    return keyed(
        out.select(
            *keys,
            total(F.col("quantity")).alias("total_qty"),
            total(F.col("amount")).alias("net_revenue_calc"),
            total_or_zero(F.col("ref_net")).alias("net_revenue_ref"),
        ),
        keys,
    )


# item_sales -------------------------------------------------------------------------------

def _dates(f: Frames) -> DataFrame:
    return beside(f, Grouping(LINES, ("ship_day",))).select(
        F.col("ship_day").alias("d_day"), F.year("ship_day").alias("d_year"), F.month("ship_day").alias("d_month"))


def _sold_lines() -> Input:
    # One row per calendar day, whatever the number of lines, so this side is broadcast.
    return Input("lines with their day", lambda f: resolve(f, STG_LINES).join(
        _dates(f).hint("broadcast"), F.col("ship_day") == F.col("d_day")))


def item_sales(f: Frames, item_key: str = "l_partkey", period: tuple[str, Column] | None = None) -> DataFrame:
    # The year's days are named as a range too, which reaches the scan of the lines.
    first, after = (F.lit(datetime.date(y, 1, 1)) for y in (ITEM_YEAR, ITEM_YEAR + 1))
    in_year = (f"year {ITEM_YEAR}", (F.col("d_year") == ITEM_YEAR) & (F.col("ship_day") >= first) & (F.col("ship_day") < after))
    calc = Grouping(_sold_lines(), (item_key,), {
        "n_orders": _by("distinct", "l_orderkey"), "units": _by("sum", "quantity"), "sales": _by("sum", "net"),
    }, period or in_year)
    ref = Grouping(_sold_lines(), ("l_partkey",), {"ref_sales": _by("sum", "net")}, in_year)
    sold = beside(f, calc, ref).withColumnRenamed(item_key, "p_partkey")
    items = f["stg_parts"].select("p_partkey", "p_name", "p_brand")
    return sold.join(items, "p_partkey").select(
        "p_partkey", "p_name", "p_brand", "n_orders",
        total(F.col("units")).alias("units_calc"),
        total(F.col("sales")).alias("sales_calc"),
        total_or_zero(F.col("ref_sales")).alias("sales_ref"),
    )


# supplier_stats ---------------------------------------------------------------------------

def supplier_stats(f: Frames, supplier_key: str = "s_suppkey", flag: str | None = None) -> DataFrame:
    kept = F.when(F.col("l_returnflag") == "N", 1).otherwise(0)
    calc = Grouping(LINES, ("l_suppkey",), {
        "n_lines_calc": _number(), "n_kept": ("sum", kept), "n_parts": _by("distinct", "l_partkey"),
    }, (f"flag {flag}", F.col("l_returnflag") == flag) if flag else None)
    ref = Grouping(LINES, ("l_suppkey",), {"ref_lines": _number()})
    suppliers = f["stg_suppliers"].select("s_suppkey", "s_name", "s_nationkey")
    if supplier_key == "s_suppkey":
        out = suppliers.join(beside(f, calc, ref), F.col("s_suppkey") == F.col("l_suppkey"))
    else:
        lines = beside(f, calc).withColumnRenamed("l_suppkey", "line_key")
        out = salted_lookup(suppliers, lines, supplier_key, "line_key", F.col("s_suppkey"), "inner")
        out = out.join(beside(f, ref), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select(
        "s_suppkey", "s_name", "s_nationkey", "n_lines_calc", "n_kept", "n_parts",
        _count(F.col("ref_lines")).alias("n_lines_ref"),
    )


_named_suppliers = Projection("supplier", lambda: {
    c: F.col(c) for c in ("s_suppkey", "s_name", "s_nationkey")}, key=("s_suppkey",))


# order_stats ------------------------------------------------------------------------------

_settled_orders = Projection("orders", lambda: {
    c: F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")
}, where=lambda: F.col("o_orderstatus").isin("F", "O"), key=("o_orderkey",))


def _returned() -> Grouping:
    return Grouping(LINES, ("l_orderkey",), {"discounts": _by("sum", "discount"), "n_returned": _number()},
                    ("returned", F.col("l_returnflag") == "R"))


def _average_discount() -> Column:
    return mean(F.col("discounts"), F.col("n_returned"), 4).alias("average_discount")


def _returns(f: Frames) -> DataFrame:
    return beside(f, _returned()).select(F.col("l_orderkey").alias("o_orderkey"), _average_discount(), "n_returned")


def _line_counts(f: Frames) -> DataFrame:
    return beside(f, Grouping(LINES, ("l_orderkey",), {"n_lines": _number()})).withColumnRenamed("l_orderkey", "o_orderkey")


def order_stats(f: Frames, status: str | None = None, returns: str = "left") -> DataFrame:
    orders = f["stg_orders"]
    if status:
        orders = orders.filter(F.col("o_orderstatus") == status)
    counted = Grouping(LINES, ("l_orderkey",), {"n_lines": _number()})
    ref = Grouping(LINES, ("l_orderkey",), {"ref_lines": _number()})
    lines = beside(f, counted, _returned(), ref)
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if returns == "inner":
        out = out.filter(F.col("n_returned").isNotNull())
    return out.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", _average_discount(), "n_returned",
        _count(F.col("n_lines")).alias("n_lines_calc"),
        _count(F.col("ref_lines")).alias("n_lines_ref"),
    )


# supplier_sales ---------------------------------------------------------------------------

def _placed_suppliers(f: Frames) -> DataFrame:
    nations = f["nation"].select("n_nationkey", "n_name", "n_regionkey")
    regions = f["region"].select("r_regionkey", "r_name")
    return (
        f["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            "s_suppkey", F.col("s_name").alias("supplier_name"),
            F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        )
    )


def supplier_sales(f: Frames, line_key: str = "l_suppkey", with_events: bool = False) -> DataFrame:
    calc = Grouping(LINES, (line_key,), {"line_rows": _number(), "units": _by("sum", "quantity"), "net": _by("sum", "net")})
    ref = Grouping(LINES, ("l_suppkey",), {"ref_net": _by("sum", "net")})
    suppliers = f["stg_suppliers"]
    if line_key == "l_suppkey":
        out = suppliers.join(beside(f, calc, ref), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    else:
        out = suppliers.join(beside(f, calc), F.col("s_suppkey") == F.col(line_key), "left").join(
            beside(f, ref), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    n = None
    if with_events:
        out = out.join(_copies(f, EVENTS, "user_id", "user_id"), F.col("s_suppkey") == F.col("user_id"), "left")
        n = times(F.col("copies"))
    return out.select(
        "s_suppkey", "supplier_name", "nation", "region",
        repeated(times(F.col("line_rows")), n).alias("n_lines"),
        total(repeated(F.col("units"), n)).alias("units_calc"),
        total_or_zero(repeated(F.col("net"), n)).alias("revenue_calc"),
        total_or_zero(F.col("ref_net")).alias("revenue_ref"),
    )


# region_stats -----------------------------------------------------------------------------

def _placed_customers(f: Frames) -> DataFrame:
    nations = f["nation"].select("n_nationkey", "n_name", "n_regionkey")
    regions = f["region"].select("r_regionkey", F.col("r_name").alias("region"))
    return (
        f["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", "c_name", "c_nationkey", "r_regionkey", "region",
            F.col("n_name").alias("nation"), money("c_acctbal").alias("balance"),
        )
    )


PLACED_CUSTOMERS = Input("customers with nation and region", _placed_customers)


def region_stats(f: Frames, customer_key: str = "r_regionkey", only_negative: bool = False) -> DataFrame:
    negative = ("negative balance", F.col("balance") < 0) if only_negative else None
    calc = beside(f, Grouping(PLACED_CUSTOMERS, (customer_key,), {
        "n_customers": _by("distinct", "c_custkey"), "n_active": ("sum", F.when(F.col("balance") >= 0, 1).otherwise(0)),
    }, negative)).withColumnRenamed(customer_key, "calc_region")
    managers = f["supplier"].select("s_suppkey", "s_name")
    nations = f["nation"].select("n_nationkey", F.col("n_regionkey").alias("ref_region"))
    ref = (
        f["customer"].select("c_nationkey")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("ref_region").agg(F.count("*").alias("ref_customers"))
    )
    return (
        f["region"].join(managers, F.col("r_regionkey") == F.col("s_suppkey"), "left")
        .join(calc, F.col("r_regionkey") == F.col("calc_region"), "left")
        .join(ref, F.col("r_regionkey") == F.col("ref_region"), "left")
        .select(
            "r_regionkey", "r_name", F.col("s_name").alias("manager"),
            _count(F.col("n_customers")).alias("n_customers_calc"),
            _count(F.col("n_active")).alias("n_active_calc"),
            _count(F.col("ref_customers")).alias("n_customers_ref"),
        )
    )


PIPELINES: dict[str, Pipeline] = {
    p.pipeline_id: p
    for p in (
        Pipeline(
            "customer_revenue", "retail", ("c_custkey",), "c_custkey",
            "L0 stg_lines, stg_orders: order lines with their net amount, and orders.\n"
            "L2 customer_revenue: per customer the number of orders, revenue_calc from the joined "
            "lines and revenue_ref recomputed apart.",
            (STG_LINES, STG_ORDERS,
             Step("customer_revenue", "L2", "revenue per customer with its recomputation", customer_revenue)),
            source_table="customer",
        ),
        Pipeline(
            "order_value", "wholesale orders", ("o_orderkey",), "o_orderkey",
            "L0 stg_lines, stg_parts, stg_orders: order lines, list prices, orders.\n"
            "L1 order_value: per order gross, net and list value, the last two also recomputed.",
            (STG_LINES, STG_PARTS, STG_ORDERS,
             Step("order_value", "L1", "value per order with its recomputation", order_value)),
            source_table="stg_orders", heavy=True,
        ),
        Pipeline(
            "order_performance", "fulfilment", ("o_orderkey",), "o_orderkey",
            "L0 stg_orders, stg_lines, stg_suppliers: orders, lines, suppliers.\n"
            "L1 order_performance: per order the suppliers used, revenue_calc along the chain and "
            "revenue_ref recomputed apart.",
            (STG_ORDERS, STG_LINES,
             STG_SUPPLIERS,
             Step("order_performance", "L1", "revenue per order with its recomputation", order_performance)),
            source_table="stg_orders",
        ),
        Pipeline(
            "sales_by_customer", "business sales", ("c_custkey",), "c_custkey",
            "L0 stg_orders, stg_purchases: orders and purchase events.\n"
            "L1 sales_by_customer: per customer ordered and paid amounts, each also recomputed.",
            (STG_ORDERS,
             STG_PURCHASES,
             Step("sales_by_customer", "L1", "sales per customer with their recomputation", sales_by_customer)),
            source_table="customer",
        ),
        Pipeline(
            "nation_profile", "demographics", ("n_nationkey",), "n_nationkey",
            "L0 stg_customers, stg_suppliers: customers and suppliers with balance.\n"
            "L1 nation_profile: per nation customers, largest balance and supplier balance, the "
            "last also recomputed.",
            (STG_CUSTOMERS,
             STG_SUPPLIERS,
             Step("nation_profile", "L1", "profile per nation with its recomputation", nation_profile)),
            source_table="nation",
        ),
        Pipeline(
            "supplier_season", "supplier seasons", ("o_year", "l_suppkey"), "row_key",
            "L0 stg_lines, stg_orders: order lines and dated orders.\n"
            "L1 supplier_season: per order year and supplier lines, first lines, early lines and "
            "mean line number; first lines also recomputed.",
            (STG_LINES,
             STG_DATED_ORDERS,
             Step("supplier_season", "L1", "season per supplier with its recomputation", supplier_season)),
            source_table="stg_lines", heavy=True,
        ),
        Pipeline(
            "part_margin", "supply chain", ("l_partkey", "l_suppkey"), "row_key",
            "L0 stg_lines, stg_orders: order lines and open orders.\n"
            "L1 part_margin: per part and supplier quantity and net revenue over open orders, the "
            "revenue also recomputed.",
            (STG_LINES,
             STG_OPEN_ORDERS,
             Step("part_margin", "L1", "margin per part and supplier with its recomputation", part_margin)),
            source_table="stg_lines", heavy=True,
        ),
        Pipeline(
            "item_sales", "retail", ("p_partkey",), "p_partkey",
            "L0 stg_lines, stg_dates, stg_parts: order lines, calendar, parts.\n"
            "L1 item_sales: per part the orders, units and sales of one year, sales also recomputed.",
            (STG_LINES,
             Step("stg_dates", "L0", "staging of the calendar", _dates),
             STG_PARTS,
             Step("item_sales", "L1", "yearly sales per part with their recomputation", item_sales)),
            source_table="stg_parts", heavy=True,
        ),
        Pipeline(
            "supplier_stats", "transport", ("s_suppkey",), "s_suppkey",
            "L0 stg_lines, stg_suppliers: order lines and suppliers.\n"
            "L1 supplier_stats: per supplier lines, kept lines and parts; lines also recomputed.",
            (STG_LINES,
             Step("stg_suppliers", "L0", "staging of suppliers", _named_suppliers),
             Step("supplier_stats", "L1", "line counts per supplier with their recomputation", supplier_stats)),
            source_table="stg_suppliers",
        ),
        Pipeline(
            "order_stats", "settled orders", ("o_orderkey",), "o_orderkey",
            "L0 stg_orders, stg_returns: settled orders and their returned lines.\n"
            "L1 stg_line_counts: lines counted per order.\n"
            "L2 order_stats: per order mean returned discount and line count, the latter also "
            "recomputed.",
            (Step("stg_orders", "L0", "staging of settled orders", _settled_orders),
             Step("stg_returns", "L0", "staging of returned lines per order", _returns),
             Step("stg_line_counts", "L1", "lines counted per order", _line_counts),
             Step("order_stats", "L2", "statistics per settled order with their recomputation", order_stats)),
            source_table="stg_orders", heavy=True,
        ),
        Pipeline(
            "supplier_sales", "catalogue", ("s_suppkey",), "s_suppkey",
            "L0 stg_suppliers, stg_lines: suppliers with nation and region, order lines.\n"
            "L1 supplier_sales: per supplier lines, units and revenue, revenue also recomputed.",
            (Step("stg_suppliers", "L0", "staging of suppliers with nation and region", _placed_suppliers),
             STG_LINES,
             Step("supplier_sales", "L1", "sales per supplier with their recomputation", supplier_sales)),
            source_table="stg_suppliers",
        ),
        Pipeline(
            "region_stats", "regional network", ("r_regionkey",), "r_regionkey",
            "L0 stg_customers: customers with nation and region.\n"
            "L1 region_stats: per region its manager and customers, the count also recomputed.",
            (Step("stg_customers", "L0", "staging of customers with nation and region", _placed_customers),
             Step("region_stats", "L1", "customers per region with their recomputation", region_stats)),
            source_table="region",
        ),
    )
}


def get_pipeline(pipeline_id: str) -> Pipeline:
    return PIPELINES[pipeline_id]
