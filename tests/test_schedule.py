"""Loan schedules against a plain fold, also very long ones."""

import time
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

from tallyworks.operators import credit

CENT = D("0.01")


def plain(principal, rate, payment, term):
    left, out = principal, []
    for no in range(1, term + 1):
        interest = (left * rate).quantize(CENT, ROUND_HALF_UP)
        part = payment - interest
        if no == term or part > left:
            part = left
        out.append((no, part, interest))
        left -= part
    return out


def test_schedules_equal_a_plain_fold(spark):
    terms = [1, 2, 12, 63, 64, 65, 128, 129, 700]
    loans = [(i, D(100_000 + 777 * i), D(rate), term) for i, (term, rate) in enumerate((t, r) for t in terms for r in (0, 12, 24))]
    df = spark.createDataFrame(loans, "loan_id long, principal_amount decimal(14,2), interest_rate decimal(7,4), term_months int").selectExpr(
        "*", "date'2020-01-31' as start_date")
    priced = df.withColumn("rate", credit.monthly_rate(df.interest_rate))
    priced = {r.loan_id: r for r in priced.withColumn("payment", credit.annuity(priced.principal_amount, priced.rate, priced.term_months)).collect()}
    got = {}
    for r in credit.build_schedule(df).orderBy("loan_id", "installment_no").collect():
        got.setdefault(r.loan_id, []).append((r.installment_no, r.principal_due, r.interest_due))
    for loan, principal, _, term in loans:
        assert got[loan] == plain(principal, priced[loan].rate, priced[loan].payment, term)


def test_very_long_schedules_take_seconds(spark):
    df = spark.sql("select 1L as loan_id, 1000000.00BD as principal_amount, 6.0000BD as interest_rate, 10000 as term_months, date'2020-01-01' as start_date")
    df = df.selectExpr("loan_id", "cast(principal_amount as decimal(14,2)) principal_amount", "cast(interest_rate as decimal(7,4)) interest_rate", "term_months", "start_date")
    begin = time.perf_counter()
    rows = credit.build_schedule(df).count()
    assert rows == 10_000 and time.perf_counter() - begin < 60
    assert credit.build_schedule(df).selectExpr("sum(principal_due)").first()[0] == D("1000000.00")
