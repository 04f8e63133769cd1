"""Bank loans: annuity schedules and instalment payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, MONTHLY_RATE, cents, half_up_div, money, whole
from tallyworks.operators.cash import ledger_rows, post_movements
from tallyworks.operators.requests import first_requests, repeated_requests
from tallyworks.session import materialise


def monthly_rate(rate: Column) -> Column:
    """Yearly percent as a monthly fraction with ten decimals."""
    units = half_up_div((whole(rate, 4) * 1000000).cast("decimal(38,0)"), F.lit(1200).cast("decimal(4,0)"))
    return (units.cast("decimal(20,0)") * F.lit("0.0000000001").cast("decimal(11,10)")).cast(MONTHLY_RATE)


def annuity(principal: Column, rate: Column, term: Column) -> Column:
    """Monthly payment. The power is computed in double and kept to ten decimals."""
    growth = F.pow((F.lit(1) + rate).cast("double"), -term.cast("double")).cast("decimal(11,10)")
    share = F.lit(1).cast("decimal(1,0)") - growth
    with_interest = cents(half_up_div(whole((principal * rate).cast("decimal(33,12)"), 12), whole(share, 10)))
    flat = cents(half_up_div(whole(principal, 2), term.cast("decimal(10,0)")))
    return F.when(rate == 0, flat).otherwise(with_interest)


#: Months that the fold of a schedule collects before it puts them aside.
BLOCK_MONTHS = 64


def build_schedule(loans: DataFrame) -> DataFrame:
    """Instalments of loans (loan_id, principal_amount, interest_rate, term_months, start_date).

    Each loan is folded month by month inside its row, so there is no shuffle. The last
    instalment takes what is left. Months are collected in blocks: adding one to an array copies the array, so
    one array for all months would cost the square of the term.
    """
    priced = loans.withColumn("_rate", monthly_rate(F.col("interest_rate"))).withColumn(
        "_payment", annuity(F.col("principal_amount"), F.col("_rate"), F.col("term_months"))
    )
    row = "struct<installment_no:int,principal_due:decimal(14,2),interest_due:decimal(14,2)>"
    def interest_on(remaining: Column) -> Column:
        return money(F.round(remaining * F.col("_rate"), 2))

    rows, blocks = f"array<{row}>", f"array<array<{row}>>"

    def state(remaining: Column, interest: Column, **lists: Column) -> Column:
        """The interest of the coming month travels along, so it is computed once per month."""
        return F.struct(remaining.alias("remaining"), interest.alias("interest"), *(c.alias(n) for n, c in lists.items()))

    def month(held: Column, no: Column) -> Column:
        remaining = held["remaining"]
        part = money(F.col("_payment") - held["interest"])
        principal = F.when((no == F.col("term_months")) | (part > remaining), remaining).otherwise(part)
        after = money(remaining - principal)
        entry = F.struct(
            no.alias("installment_no"), principal.alias("principal_due"), held["interest"].alias("interest_due")
        )
        return state(after, interest_on(after), rows=F.array_append(held["rows"], entry).cast(rows), blocks=held["blocks"])

    def block(held: Column, first: Column) -> Column:
        months = F.sequence(first, F.least(first + F.lit(BLOCK_MONTHS - 1), F.col("term_months")))
        begin = state(held["remaining"], held["interest"], rows=F.array().cast(rows), blocks=held["blocks"])
        return F.aggregate(
            months,
            begin,
            month,
            lambda s: state(s["remaining"], s["interest"], blocks=F.array_append(s["blocks"], s["rows"]).cast(blocks)),
        )

    principal = money(F.col("principal_amount"))
    start = state(principal, interest_on(F.col("principal_amount")), blocks=F.array().cast(blocks))
    firsts = F.sequence(F.lit(1), F.col("term_months"), F.lit(BLOCK_MONTHS))
    plan = F.aggregate(firsts, start, block, lambda s: F.flatten(s["blocks"]))
    return priced.select("loan_id", "start_date", F.inline(plan)).select(
        "loan_id",
        "installment_no",
        F.add_months("start_date", F.col("installment_no")).alias("due_date"),
        "principal_due",
        "interest_due",
    )


def take_loans(requests: DataFrame, accounts: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Grant loans (loan_id, bank_name, principal_amount, interest_rate, term_months, start_date,
    account_id) in order of ``loan_id``; the money arrives in the account."""
    account = accounts.select("account_id", F.lit(True).alias("_account"))
    code = (
        F.when(F.col("principal_amount").isNull() | (F.col("principal_amount") <= 0), 55001)
        .when(F.col("interest_rate").isNull() | (F.col("interest_rate") < 0), 55002)
        .when(F.col("term_months").isNull() | (F.col("term_months") <= 0), 55003)
        .when(F.col("_account").isNull(), 50003)
    )
    outcome = (
        requests.join(account, "account_id", "left")
        .withColumn("reason_code", code)
        .withColumn("start_date", F.coalesce("start_date", F.lit(as_of).cast("date")))
        .select(*requests.columns, "reason_code")
    )
    granted = outcome.filter(F.col("reason_code").isNull())
    loans = granted.select(
        "loan_id",
        "bank_name",
        "start_date",
        "principal_amount",
        "interest_rate",
        "term_months",
        F.lit("active").alias("status"),
        F.col("principal_amount").alias("current_principal"),
    )
    cash = post_movements(
        granted.select(
            F.col("loan_id").alias("seq"),
            "account_id",
            F.lit("in").alias("direction"),
            F.col("principal_amount").alias("amount"),
            F.lit("loan_received").alias("category"),
            F.lit("loans").alias("reference_table"),
            F.col("loan_id").alias("reference_id"),
            F.lit("bank loan received").alias("description"),
        ),
        accounts,
    )
    schedule = build_schedule(loans).select(
        "*", F.lit(False).alias("paid"), F.lit(None).cast("date").alias("paid_at")
    )
    return {
        "outcome": outcome,
        "loans": loans,
        "loan_schedule": schedule,
        "cash_accounts": cash["accounts"],
        "cash_movements": ledger_rows(cash["accepted"]),
    }


def settle_loans(loans: DataFrame, payments: DataFrame) -> DataFrame:
    """Loans after payments (loan_id, principal_paid): principal down to zero at least, closed at zero."""
    paid = payments.groupBy("loan_id").agg(F.sum("principal_paid").alias("_paid"))
    left = F.col("current_principal") - F.col("_paid")
    return (
        loans.join(paid, "loan_id", "left")
        .withColumn(
            "current_principal",
            F.when(F.col("_paid").isNull(), F.col("current_principal"))
            .when(left < 0, F.lit(0))
            .otherwise(left)
            .cast(MONEY),
        )
        .withColumn(
            "status",
            F.when(F.col("_paid").isNull(), F.col("status"))
            .when(F.col("current_principal") <= 0, "closed")
            .otherwise("active"),
        )
        .select(*loans.columns)
    )


def pay_instalments(
    requests: DataFrame, loans: DataFrame, schedule: DataFrame, accounts: DataFrame, as_of: str
) -> dict[str, DataFrame]:
    """Pay instalments (seq, loan_id, installment_no, account_id[, payment_date]) in order of ``seq``.

    Of several requests for one instalment the first is tried. Once it is accepted the others are
    refused as paid (55004); if it is refused for its own sake they get the same code. Only after a refusal
    for want of cash or an account do they come back as ``deferred``, to be tried in the next batch. A
    request without a loan or a number gets 55005.
    """
    today = F.lit(as_of).cast("date")
    date = F.coalesce("payment_date", today) if "payment_date" in requests.columns else today
    keys = ["loan_id", "installment_no"]
    marked, _ = first_requests(materialise(requests.withColumn("payment_date", date), "instalment-requests"), keys)
    marked = materialise(marked, "instalment-firsts")
    counted = marked.filter(F.col("seq") == F.col("_first")).drop("_first")
    plan = schedule.select(*keys, "principal_due", "interest_due", "paid")
    code = F.when(F.col("paid"), 55004).when(F.col("paid").isNull(), 55005)
    checked = materialise(counted.join(plan, keys, "left").withColumn("_code", code), "instalments")
    cash = post_movements(
        checked.filter(F.col("_code").isNull()).select(
            "seq",
            "account_id",
            F.lit("out").alias("direction"),
            money(F.col("principal_due") + F.col("interest_due")).alias("amount"),
            F.lit("loan_payment").alias("category"),
            F.lit("loan_schedule").alias("reference_table"),
            F.col("loan_id").alias("reference_id"),
            F.lit("loan instalment").alias("description"),
            "payment_date",
            "installment_no",
            "principal_due",
            "interest_due",
        ),
        accounts,
    )
    loan = F.col("reference_id").alias("loan_id")
    payments = cash["accepted"].select(
        loan,
        "installment_no",
        "payment_date",
        F.col("principal_due").alias("principal_paid"),
        F.col("interest_due").alias("interest_paid"),
    )
    outcome = (
        checked.filter(F.col("_code").isNotNull())
        .select("seq", *keys, F.col("_code").alias("reason_code"))
        .unionByName(cash["outcome"].select("seq", loan, "installment_no", "reason_code"))
    )
    repeated, deferred = repeated_requests(marked, outcome, keys, 55004)
    outcome = outcome.unionByName(repeated)
    return {
        "outcome": outcome,
        "deferred": deferred,
        "loans": settle_loans(loans, payments),
        "loan_schedule": mark_paid(schedule, payments),
        "loan_payments": payments,
        "cash_accounts": cash["accounts"],
        "cash_movements": ledger_rows(cash["accepted"]),
    }


def mark_paid(schedule: DataFrame, payments: DataFrame) -> DataFrame:
    """Schedule with the paid flag and date of the instalments in ``payments``."""
    done = payments.select("loan_id", "installment_no", F.col("payment_date").alias("_date"))
    return (
        schedule.join(done, ["loan_id", "installment_no"], "left")
        .withColumn("paid", F.col("paid") | F.col("_date").isNotNull())
        .withColumn("paid_at", F.coalesce("_date", "paid_at"))
        .select(*schedule.columns)
    )
