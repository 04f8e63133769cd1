"""One full business cycle with known results, from purchase to reports, over snapshots."""

import datetime as dt
from decimal import Decimal as D

import pytest

from demo import FEBRUARY, PURCHASE, SALES, TODAY, day, tables
from tallyworks.operators import credit, merge, payroll, procurement, production, sales
from tallyworks.plans import reports
from tallyworks.plans.views import VIEWS, register_books
from tallyworks.schemas import TABLES
from tallyworks.sources.tables import append_rows, empty_table, read_snapshot, read_table, rows, write_snapshot

AS_OF = TODAY.isoformat()


@pytest.fixture(scope="module")
def cycle(spark, tmp_path_factory):
    t = tables(spark)
    t["purchase_request"] = spark.createDataFrame([(1, 1, day(5))], "doc_id long, supplier_id long, expected_date date")
    pages = spark.createDataFrame([(1, PURCHASE)], "doc_id long, items_json string")
    bought = procurement.create_purchase_orders(t["purchase_request"], pages, t["suppliers"], t["raw_materials"], AS_OF)
    got = procurement.receive_purchase_orders(
        spark.createDataFrame([(1, 1, 1)], "seq long, purchase_id long, account_id long"),
        bought["purchase_orders"], bought["purchase_order_items"], t["raw_inventory"], t["cash_accounts"], AS_OF)
    made = production.run_production(
        spark.createDataFrame([(1, 1, D(200), TODAY), (2, 2, D(120), TODAY), (3, 3, D(150), TODAY)],
                              "production_order_id long, product_id long, quantity decimal(14,3), order_date date"),
        t["products"], t["bill_of_materials"], got["raw_inventory"], t["finished_inventory"], AS_OF)
    sold = sales.create_sales(
        spark.createDataFrame([(1, 1, 1, TODAY), (2, 2, 1, TODAY)], "doc_id long, customer_id long, account_id long, sales_date date"),
        spark.createDataFrame([(1, SALES[0]), (2, SALES[1])], "doc_id long, items_json string"),
        t["customers"], made["products"], made["finished_inventory"], got["cash_accounts"], AS_OF)
    feb = dt.date(2026, 2, 1)
    sheets = merge.upsert(
        t["timesheets"],
        rows(spark, "timesheets", [(e, feb, n, D(b), D(x)) for e, n, b, x in FEBRUARY],
             "employee_id period_month worked_days bonus deductions").drop("timesheet_id"),
        ["employee_id", "period_month"])
    calculated = payroll.calculate_payroll("2026-02-15", t["employees"], t["positions"], sheets)
    due = payroll.merge_payroll(rows(spark, "payroll", []), calculated)
    paid = payroll.pay_payroll("2026-02-01", due, sold["cash_accounts"], 1, AS_OF)
    loan = credit.take_loans(
        spark.createDataFrame([(1, "Bank", D(5000000), D(18), 12, TODAY, 1)],
                              "loan_id long, bank_name string, principal_amount decimal(14,2), interest_rate decimal(7,4), "
                              "term_months int, start_date date, account_id long"),
        paid["cash_accounts"], AS_OF)
    settled = credit.pay_instalments(
        spark.createDataFrame([(1, 1, 1, 1, day(30))], "seq long, loan_id long, installment_no int, account_id long, payment_date date"),
        loan["loans"], loan["loan_schedule"], loan["cash_accounts"], AS_OF)
    final = {
        **t,
        "raw_inventory": made["raw_inventory"],
        "finished_inventory": sold["finished_inventory"],
        "production_orders": made["production_orders"],
        "production_consumption": made["production_consumption"],
        "purchase_orders": got["purchase_orders"],
        "purchase_order_items": bought["purchase_order_items"],
        "sales_orders": sold["sales_orders"],
        "sales_order_items": sold["sales_order_items"],
        "products": made["products"],
        "payroll": paid["payroll"],
        "loans": settled["loans"],
        "loan_schedule": settled["loan_schedule"],
        "loan_payments": settled["loan_payments"],
        "cash_accounts": settled["cash_accounts"],
    }
    folder = str(tmp_path_factory.mktemp("books") / "day1")
    final.pop("purchase_request")
    write_snapshot(final, folder)
    for step in (got, sold, paid, loan, settled):
        append_rows(step["cash_movements"], folder, "cash_movements")
    out = {name: read_table(spark, folder, name) for name in [*final, "cash_movements"]}
    return out, {"got": got, "bought": bought, "folder": folder, "final": final}


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_purchase(cycle):
    t, step = cycle
    assert values(t["purchase_orders"], "status", "received_date", "total_amount") == [("received", TODAY, D("2248000.00"))]
    assert step["got"]["cash_accounts"].first().balance == D("12752000.00")


def test_production(cycle):
    t, _ = cycle
    view = reports.production_summary(t["production_orders"], t["products"])
    assert values(view, "production_order_id", "status", "total_cost", "unit_cost") == [
        (1, "completed", D("350800.00"), D("1754.00")),
        (2, "completed", D("288288.00"), D("2402.40")),
        (3, "completed", D("307020.00"), D("2046.80")),
    ]
    assert values(t["products"], "product_id", "standard_cost") == [
        (1, D("1754.00")), (2, D("2402.40")), (3, D("2046.80"))]
    cost = {r.production_order_id: r.c for r in t["production_consumption"].groupBy("production_order_id")
            .agg({"line_cost": "sum"}).withColumnRenamed("sum(line_cost)", "c").collect()}
    assert cost == {1: D("350800"), 2: D("288288"), 3: D("307020")}


def test_raw_material_balance(cycle):
    t, _ = cycle
    view = reports.raw_material_balance(t["raw_materials"], t["raw_inventory"])
    assert values(view, "raw_material_id", "quantity", "avg_cost", "stock_value", "shortage") == [
        (1, D("460"), D("1450"), D("667000"), D("40")),
        (2, D("174"), D("1200"), D("208800"), D("126")),
        (3, D("321.4"), D("280"), D("89992"), D("0")),
        (4, D("3000"), D("35"), D("105000"), D("0")),
        (5, D("380"), D("220"), D("83600"), D("120")),
        (6, D("295"), D("500"), D("147500"), D("0")),
    ]


def test_finished_product_balance(cycle):
    t, _ = cycle
    view = reports.finished_product_balance(t["products"], t["finished_inventory"])
    assert values(view, "product_id", "quantity", "avg_cost", "inventory_cost", "inventory_retail_value") == [
        (1, D("80"), D("1754"), D("140320"), D("680000")),
        (2, D("70"), D("2402.4"), D("168168"), D("1155000")),
        (3, D("80"), D("2046.8"), D("163744"), D("1000000")),
    ]


def test_sales_summary(cycle):
    t, _ = cycle
    view = reports.sales_summary(t["sales_orders"], t["customers"], t["sales_order_items"])
    assert values(view, "sales_id", "status", "revenue", "cogs", "gross_profit") == [
        (1, "paid", D("1955000"), D("330600"), D("1624400")),
        (2, "paid", D("875000"), D("143276"), D("731724")),
    ]


def test_payroll(cycle):
    t, _ = cycle
    assert values(t["payroll"], "employee_id", "gross_salary", "tax_amount", "net_salary", "status") == [
        (1, D("238000.00"), D("23800.00"), D("214200.00"), "paid"),
        (2, D("197909.09"), D("19790.91"), D("178118.18"), "paid"),
        (3, D("230000.00"), D("23000.00"), D("207000.00"), "paid"),
        (4, D("285000.00"), D("28500.00"), D("256500.00"), "paid"),
        (5, D("300000.00"), D("30000.00"), D("270000.00"), "paid"),
    ]
    assert values(
        reports.monthly_payroll(t["payroll"]), "employees_count", "total_gross_salary", "total_tax", "total_net_salary"
    ) == [(5, D("1250909.09"), D("125090.91"), D("1125818.18"))]


def test_loan(cycle):
    t, _ = cycle
    plan = {r.installment_no: r for r in t["loan_schedule"].collect()}
    assert plan[1].total_due == D("458399.96")
    assert (plan[1].principal_due, plan[1].interest_due, plan[1].paid) == (D("383399.96"), D("75000.00"), True)
    assert (plan[12].principal_due, plan[12].interest_due, plan[12].total_due) == (
        D("451625.64"), D("6774.38"), D("458400.02"))
    assert sum(r.principal_due for r in plan.values()) == D("5000000")
    view = reports.loans_status(t["loans"], t["loan_schedule"])
    assert values(view, "status", "current_principal", "paid_installments", "total_installments", "next_due_date") == [
        ("active", D("4616600.04"), 1, 12, dt.date(2026, 5, 10))]


def test_period_summary_and_kpi_agree(cycle):
    t, _ = cycle
    flows = [t[n] for n in ("sales_orders", "sales_order_items", "purchase_orders", "payroll", "loan_payments")]
    row = reports.period_summary(day(-60).isoformat(), day(60).isoformat(), *flows, t["cash_accounts"]).first()
    assert (row.revenue, row.cogs, row.gross_profit) == (D("2830000"), D("473876"), D("2356124"))
    assert (row.purchase_expense, row.payroll_expense, row.loan_interest_expense) == (
        D("2248000"), D("1125818.18"), D("75000"))
    assert (row.operating_profit, row.current_cash_balance) == (D("1155305.82"), D("18997781.86"))
    months = values(reports.company_kpi_monthly(*flows), "month", "operating_profit")
    assert months == [(dt.date(2026, 3, 1), D("1230305.82")), (dt.date(2026, 4, 1), D("-75000.00"))]
    assert sum(m[1] for m in months) == row.operating_profit
    empty = reports.period_summary("2020-01-01", "2020-01-31", *flows, t["cash_accounts"]).first()
    assert (empty.revenue, empty.operating_profit, empty.current_cash_balance) == (D(0), D(0), D("18997781.86"))


def test_ledger_explains_the_balance(cycle):
    t, _ = cycle
    moved = values(t["cash_movements"], "category", "direction", "amount")
    assert moved == [
        ("loan_payment", "out", D("458399.96")), ("loan_received", "in", D("5000000.00")), ("payroll", "out", D("1125818.18")),
        ("purchase", "out", D("2248000.00")), ("sale", "in", D("875000.00")), ("sale", "in", D("1955000.00"))]
    change = sum(a if d == "in" else -a for _, d, a in moved)
    assert t["cash_accounts"].first().balance == D(15000000) + change


def test_snapshot_is_not_overwritten_and_views_work(spark, cycle):
    t, step = cycle
    with pytest.raises(Exception):
        write_snapshot({"loans": t["loans"]}, step["folder"])
    names = register_books(t)
    assert set(VIEWS) <= set(names)
    assert spark.sql("SELECT * FROM v_loans_status ORDER BY loan_id").count() == 1
    assert [r.product_name for r in spark.sql("SELECT * FROM v_finished_product_balance ORDER BY product_name").collect()] == [
        "Hoodie", "Pants", "T-shirt"]
    assert spark.sql("SELECT * FROM v_raw_material_balance ORDER BY material_name").first().material_name == "Buttons"
    assert spark.sql("SELECT * FROM v_production_summary ORDER BY production_order_id").count() == 3
    assert spark.sql("SELECT * FROM v_sales_summary ORDER BY sales_id").count() == 2
    assert spark.sql("SELECT * FROM v_monthly_payroll ORDER BY period_month").first().employees_count == 5
    assert [r.month for r in spark.sql("SELECT * FROM v_company_kpi_monthly ORDER BY month").collect()] == [
        dt.date(2026, 3, 1), dt.date(2026, 4, 1)]


def test_snapshot_reads_back(spark, tmp_path):
    folder = write_snapshot({n: empty_table(spark, n) for n in TABLES}, str(tmp_path / "new"))
    tables_read = read_snapshot(spark, folder)
    assert len(tables_read) == 24 and all(df.count() == 0 for df in tables_read.values())
    assert register_books(tables_read)
    assert spark.sql("SELECT * FROM v_company_kpi_monthly").count() == 0
