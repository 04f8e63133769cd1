"""Monthly payroll: calculation and payout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, money, month_start, total, whole
from tallyworks.operators.cash import ledger_rows, post_movements
from tallyworks.operators.merge import update_where
from tallyworks.session import materialise

# Working days of a full month and the tax rate.
FULL_MONTH = 22
TAX = "0.10"


def calculate_payroll(
    periods: str | Sequence[str], employees: DataFrame, positions: DataFrame, timesheets: DataFrame
) -> DataFrame:
    """Pay of the active employees for the month of each period; no timesheet counts as a full month.

    The daily rate is cut after six decimals, as the decimal type of the quotient does.
    """
    months = [month_start(F.lit(p).cast("date")) for p in ([periods] if isinstance(periods, str) else periods)]
    days = timesheets.filter(F.col("period_month").isin(*months)).select(
        "employee_id", "period_month", "worked_days", "bonus", "deductions"
    )
    micro = F.call_function(
        "div", (whole(F.col("base_salary"), 2) * 10000).cast("decimal(38,0)"), F.lit(FULL_MONTH).cast("decimal(2,0)")
    )
    daily = (micro.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(19,6)")
    zero = F.lit(0).cast(MONEY)
    raw = (
        daily * F.coalesce("worked_days", F.lit(FULL_MONTH)).cast("decimal(10,0)")
        + F.coalesce("bonus", zero)
        - F.coalesce("deductions", zero)
    )
    gross = money(F.greatest(F.round(raw, 2), zero.cast("decimal(38,2)")))
    tax = money(F.round(F.col("gross_salary") * F.lit(TAX).cast("decimal(3,2)"), 2))
    return (
        employees.filter("is_active")
        .join(positions.select("position_id", "base_salary"), "position_id")
        .select("employee_id", "base_salary", F.explode(F.array(*months)).alias("period_month"))
        .join(days, ["employee_id", "period_month"], "left")
        .select("employee_id", "period_month", gross.alias("gross_salary"))
        .withColumn("tax_amount", tax)
        .withColumn("net_salary", money(F.round(F.col("gross_salary") - F.col("tax_amount"), 2)))
    )


def merge_payroll(payroll: DataFrame, calculated: DataFrame, protect_paid: bool = False) -> DataFrame:
    """Upsert calculated pay by (employee, month).

    A row that was paid goes back to calculated, and so can be paid again; ``protect_paid``
    leaves such rows as they are.
    """
    keys = ["employee_id", "period_month"]
    pay = ["gross_salary", "tax_amount", "net_salary"]
    new = calculated.select(*keys, *[F.col(c).alias(f"_{c}") for c in pay], F.lit(True).alias("_new"))
    joined = payroll.join(new, keys, "full_outer")
    take = F.coalesce("_new", F.lit(False))
    if protect_paid:
        take = take & (F.coalesce("status", F.lit("calculated")) != "paid")
    fresh = {c: F.col(f"_{c}") for c in pay} | {"status": F.lit("calculated"), "paid_date": F.lit(None).cast("date")}
    return joined.select(
        *[F.when(take, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in payroll.columns]
    )


def pay_payroll(
    period: str, payroll: DataFrame, accounts: DataFrame, account_id: int, paid_date: str
) -> dict[str, DataFrame]:
    """Pay all calculated rows of the month from one account.

    ``outcome`` is one row with total_paid and the reason_code; a refused payout changes nothing.
    """
    month = month_start(F.lit(period).cast("date"))
    due = (F.col("period_month") == month) & (F.col("status") == "calculated")
    amount = payroll.filter(due).agg(
        F.coalesce(total(F.sum("net_salary")), F.lit(0)).cast("decimal(38,2)").alias("total_paid")
    )
    payout = amount.filter("total_paid > 0").select(
        F.lit(1).cast("bigint").alias("seq"),
        F.lit(account_id).cast("bigint").alias("account_id"),
        F.lit("out").alias("direction"),
        money(F.col("total_paid")).alias("amount"),
        F.lit("payroll").alias("category"),
        F.lit("payroll").alias("reference_table"),
        F.lit(None).cast("bigint").alias("reference_id"),
        F.lit("salary payout").alias("description"),
    )
    cash = post_movements(materialise(payout, "payout"), accounts)
    posted = cash["outcome"].agg(
        F.count(F.lit(1)).alias("_n"), F.max("reason_code").alias("_code"), F.max("amount").alias("total_paid")
    )
    outcome = posted.select(
        month.alias("period_month"),
        F.when(F.col("_n") == 0, 54001).otherwise(F.col("_code")).alias("reason_code"),
        "total_paid",
    )
    # One row, so the join only carries the flag of the payout to the payroll rows.
    paid = outcome.filter("reason_code is null").select(F.col("period_month").alias("_month"))
    rows = payroll.join(F.broadcast(paid), F.col("period_month") == F.col("_month"), "left")
    updated = update_where(
        rows,
        F.col("_month").isNotNull() & (F.col("status") == "calculated"),
        status=F.lit("paid"),
        paid_date=F.lit(paid_date).cast("date"),
    )
    return {
        "outcome": outcome,
        "payroll": updated.select(*payroll.columns),
        "cash_accounts": cash["accounts"],
        "cash_movements": ledger_rows(cash["accepted"]),
    }
