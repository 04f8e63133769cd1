"""Decimal arithmetic: every rounding is half away from zero and happens once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
QUANTITY = "decimal(14,3)"
RATE = "decimal(7,4)"
MONTHLY_RATE = "decimal(18,10)"
TOTAL = "decimal(38,2)"

#: Reason code of a document whose quantity or amount is beyond its column.
OVERFLOW = 8115


def money(c: Column) -> Column:
    return c.cast(MONEY)


def money_or_null(c: Column) -> Column:
    """``c`` as money, null if it is too large."""
    return c.try_cast(MONEY)


def quantity(c: Column) -> Column:
    return c.cast(QUANTITY)


def total(c: Column) -> Column:
    """Round a sum of money products to cents; an empty sum stays null."""
    return F.round(c, 2).cast(TOTAL)


def total_or_zero(c: Column) -> Column:
    return total(F.coalesce(c, F.lit(0).cast("decimal(38,5)")))


def zero_if_null(c: Column, kind: str) -> Column:
    """Null default that keeps the type of the tested column."""
    return F.coalesce(c, F.lit(0)).cast(kind)


def whole(c: Column, digits: int) -> Column:
    """The decimal ``c`` as a whole number of ``10**-digits`` units."""
    return (c * F.lit(10**digits)).cast("decimal(38,0)")


def half_up_div(num: Column, den: Column) -> Column:
    """Whole-number quotient rounded half up, for num >= 0 and den > 0; null when den is 0.

    Decimal division would round once at its own scale and a second time on rounding to
    cents, which can move the last cent.
    """
    two = F.lit(2).cast("decimal(1,0)")
    safe = F.when(den != 0, den)
    n = (two * num + safe).cast("decimal(38,0)")
    d = (two * safe).cast("decimal(38,0)")
    return F.call_function("div", n, d)


def cents(units: Column) -> Column:
    """A whole number of cents as money. The product has 18 digits, which Spark keeps in a long."""
    return (units.cast("decimal(15,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def ratio(num: Column, den: Column) -> Column:
    """num / den rounded to cents (amount per unit); null when den is 0. Both are non-negative,
    with at most 5 digits after the point in ``num`` and 3 in ``den``."""
    return cents(half_up_div(whole(num, 5), whole(den, 3)))


def moving_avg_cost(stock: Column, avg_cost: Column, received: Column, cost: Column) -> Column:
    """Average cost after ``received`` units worth ``cost`` join ``stock`` units at ``avg_cost``."""
    pool = stock + received
    value = (stock * avg_cost).cast("decimal(38,5)") + cost.cast("decimal(38,5)")
    return F.when(pool == 0, F.lit(0).cast(MONEY)).otherwise(ratio(value, pool))


def line_total(qty: Column, price: Column) -> Column:
    """Computed line amount: quantity times price, unrounded."""
    return qty.cast(QUANTITY) * price.cast(MONEY)


def per_unit(amount: Column, qty: Column) -> Column:
    """Cost per unit with the zero guard: 0 where nothing was made."""
    return F.when(qty == 0, F.lit(0).cast(MONEY)).otherwise(ratio(amount, qty))


def month_start(d: Column) -> Column:
    """First day of the month of ``d``."""
    return F.trunc(d, "MONTH").cast("date")
