"""Exact arithmetic columns.

Sums of doubles depend on the order rows arrive in, so two correct plans can disagree in the
last cent. Money is therefore decimal from the scan to the last comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"
LINE = "decimal(18,4)"
TOTAL = "decimal(38,2)"


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def rate(name: str) -> Column:
    return F.col(name).cast(RATE)


def discounted(price: str, discount: str) -> Column:
    """price * (1 - discount), exact to four decimals."""
    return (money(price) * (F.lit(1).cast(RATE) - rate(discount))).cast(LINE)


def total(amount: Column) -> Column:
    """A reported amount: two decimals, half up."""
    return F.round(amount, 2).cast(TOTAL)


def total_or_zero(amount: Column) -> Column:
    return total(F.coalesce(amount, F.lit(0).cast(MONEY)))


def mean(amount: Column, count: Column, places: int) -> Column:
    """Rounded quotient of an exact sum and a count; NULL for an empty group."""
    exact = amount.cast("decimal(28,4)") / F.nullif(count, F.lit(0)).cast("decimal(18,0)")
    return F.round(exact, places).cast(f"decimal(18,{places})")


def times(count: Column) -> Column:
    """Row multiplicity after a left join: an unmatched row still counts once."""
    return F.coalesce(count, F.lit(1).cast("bigint"))


def repeated(amount: Column, copies: Column | None) -> Column:
    """An amount counted once per copy; untouched, and so in its narrow type, without copies."""
    return amount if copies is None else amount * copies


def yyyymm(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_shift(month: Column, months: Column | int) -> Column:
    """Move a yyyymm number by a number of months."""
    first = F.make_date(F.floor(month / 100).cast("int"), F.pmod(month, F.lit(100)).cast("int"), F.lit(1))
    return yyyymm(F.add_months(first, months))
