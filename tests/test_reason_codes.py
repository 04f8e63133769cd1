"""One refused document per reason code, next to accepted ones."""

from decimal import Decimal as D

import pytest

from demo import TODAY, tables
from tallyworks.operators import cash, credit, payroll, procurement, production, sales
from tallyworks.operators.acceptance import accept_in_order
from tallyworks.sources.tables import rows

AS_OF = TODAY.isoformat()


@pytest.fixture(scope="module")
def books(spark):
    return tables(spark)


def codes(df, key):
    return {r[key]: r.reason_code for r in df.collect()}


def test_cash(spark, books):
    moves = spark.createDataFrame(
        [
            (1, 1, "in", D("0.00")),
            (2, 1, "in", None),
            (3, 1, "sideways", D(5)),
            (4, 1, None, D(5)),
            (5, 9, "in", D(5)),
            (6, 9, "out", D(5)),
            (7, 1, "out", D("15000000.01")),
            (8, 1, "out", D("15000000.00")),
            (9, 1, "out", D("0.01")),
            (10, 1, "in", D("0.01")),
        ],
        "seq long, account_id long, direction string, amount decimal(14,2)",
    ).selectExpr("*", "'test' as category")
    posted = cash.post_movements(moves, books["cash_accounts"])
    assert codes(posted["outcome"], "seq") == {
        1: 50001, 2: 50001, 3: 50002, 4: 50002, 5: 50003, 6: 50004, 7: 50005, 8: None, 9: 50005, 10: None}
    assert posted["accounts"].first().balance == D("0.01")
    assert posted["accepted"].count() == 2 and posted["rejected"].count() == 8
    assert cash.ledger_rows(posted["accepted"]).count() == 2


GOOD = '{"raw_material_id": 1, "quantity": 2, "unit_price": 10.5}'


def test_purchase_documents(spark, books):
    pages = [
        (1, f"[{GOOD}]"),
        (2, f"[{GOOD}"),
        (3, "[]"),
        (5, '[{"raw_material_id": 1, "quantity": 0, "unit_price": 1}]'),
        (6, '[{"raw_material_id": 1, "quantity": 1, "unit_price": 0}]'),
        (7, '[{"raw_material_id": 1, "unit_price": 1}]'),
        (8, '[{"raw_material_id": 77, "quantity": 1, "unit_price": 1}]'),
        (9, GOOD),
        (10, f"[{GOOD}]"),
        (10, f"[{GOOD}, {GOOD}]"),
        (11, f"[{GOOD}]"),
        (11, "not json"),
        (12, "[" + GOOD.replace("2", "0.0005").replace("10.5", "1.99") + "]"),
        (13, ""),
        (14, '[{"raw_material_id": 1, "quantity": 99999999999, "unit_price": 99999999999}]'),
    ]
    documents = [(i, 99 if i == 99 else 1) for i in [*range(1, 15), 99]]
    made = procurement.create_purchase_orders(
        spark.createDataFrame(documents, "doc_id long, supplier_id long"),
        spark.createDataFrame(pages, "doc_id long, items_json string"),
        books["suppliers"],
        books["raw_materials"],
        AS_OF,
    )
    assert codes(made["outcome"], "doc_id") == {
        1: None, 2: 51002, 3: 51003, 4: 51003, 5: 51004, 6: 51004, 7: 51004, 8: 51005, 9: None, 10: None, 11: 51002,
        12: None, 13: 51002, 14: 8115, 99: 51001}
    orders = {r.purchase_id: r for r in made["purchase_orders"].collect()}
    assert {k: r.total_amount for k, r in orders.items()} == {1: D("21.00"), 9: D("21.00"), 10: D("63.00"), 12: D("0.00")}
    assert orders[1].order_date == TODAY and orders[1].status == "ordered"
    assert made["purchase_order_items"].count() == 6


def test_purchase_receipts(spark, books):
    orders = rows(spark, "purchase_orders", [
        (1, 1, TODAY, "ordered", D("14999990.00")), (2, 1, TODAY, "received", D("1.00")), (3, 1, TODAY, "ordered", D("10.01")),
        (4, 1, TODAY, "ordered", D("10.00"))], "purchase_id supplier_id order_date status total_amount")
    items = rows(spark, "purchase_order_items", [
        (1, 1, D("14999990"), D(1)), (3, 2, D("10.01"), D(1)), (4, 2, D(4), D("2.5"))],
        "purchase_id raw_material_id quantity unit_price")
    requests = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 1, 1), (7, 4, 1),
                (8, None, 1), (9, 3, 1), (10, 2, 1), (11, None, 1), (12, 5, 1)]
    got = procurement.receive_purchase_orders(
        spark.createDataFrame(requests, "seq long, purchase_id long, account_id long"),
        orders, items, books["raw_inventory"], books["cash_accounts"], AS_OF)
    assert codes(got["outcome"], "seq") == {
        1: None, 2: 51007, 3: 50005, 4: None, 5: 51006, 6: 51007, 7: 51007, 8: 51006, 10: 51007, 11: 51006, 12: 51006}
    assert sorted(r.seq for r in got["deferred"].collect()) == [9]
    assert got["cash_accounts"].first().balance == D("0.00")
    stock = {r.raw_material_id: (r.quantity, r.avg_cost) for r in got["raw_inventory"].collect()}
    assert stock[1] == (D("14999990"), D("1")) and stock[2] == (D("4"), D("2.50")) and stock[3] == (D(0), D(0))
    status = {r.purchase_id: (r.status, r.received_date) for r in got["purchase_orders"].collect()}
    assert status == {1: ("received", TODAY), 2: ("received", None), 3: ("ordered", None), 4: ("received", TODAY)}


def test_production(spark, books):
    stock = rows(spark, "raw_inventory", [(1, D("10.000"), D("5.00")), (3, D("1.000"), D("2.00"))], "raw_material_id quantity avg_cost")
    recipe = rows(spark, "bill_of_materials", [(1, 1, D("1")), (1, 3, D("0.05")), (2, 2, D("1"))])
    runs = [
        (1, 1, D("0")), (2, 1, None), (3, 99, D(1)), (4, 3, D(1)), (5, 2, D(1)), (6, 1, D("10.001")), (7, 1, D("9.999")),
        (8, 1, D("0.002")), (9, 1, D("0.001")),
    ]
    made = production.run_production(
        spark.createDataFrame(runs, "production_order_id long, product_id long, quantity decimal(14,3)").selectExpr("*", "cast(null as date) order_date"),
        books["products"], recipe, stock, books["finished_inventory"], AS_OF)
    # The needs of run 9 round to zero, which consumption lines do not allow.
    assert codes(made["outcome"], "production_order_id") == {
        1: 52001, 2: 52001, 3: 52002, 4: 52003, 5: 52004, 6: 52005, 7: None, 8: 52005, 9: 547}
    left = {r.raw_material_id: r.quantity for r in made["raw_inventory"].collect()}
    assert left == {1: D("0.001"), 3: D("0.500")}
    assert made["production_orders"].first().order_date == TODAY


def test_oversized_run(spark, books):
    stock = rows(spark, "raw_inventory", [(1, D("10.000"), D("5.00"))], "raw_material_id quantity avg_cost")
    recipe = rows(spark, "bill_of_materials", [(1, 1, D("100"))])
    made = production.run_production(
        spark.createDataFrame([(1, 1, D("99999999999")), (2, 1, D("0.05"))], "production_order_id long, product_id long, quantity decimal(14,3)")
        .selectExpr("*", "cast(null as date) order_date"),
        books["products"], recipe, stock, books["finished_inventory"], AS_OF)
    assert codes(made["outcome"], "production_order_id") == {1: 8115, 2: None}


def test_sales(spark, books):
    shelf = rows(spark, "finished_inventory", [(1, D("10"), D("3.00")), (2, D("5"), D("4.00"))], "product_id quantity avg_cost")
    one = '{"product_id": %s, "quantity": %s}'
    pages = [
        (1, f"[{one % (1, 4)}, {one % (1, 4)}]"),
        (2, f"[{one % (1, 4)}"),
        (3, "[]"),
        (4, f"[{one % (1, 0)}]"),
        (5, '[{"product_id": 1, "quantity": 1, "unit_price": -1}]'),
        (6, f"[{one % (55, 1)}]"),
        (7, f"[{one % (3, 1)}]"),
        (8, f"[{one % (1, '2.001')}]"),
        (9, '[{"product_id": 1, "quantity": 2, "unit_price": 0}]'),
        (10, f"[{one % (1, 1)}, {one % (2, 6)}]"),
        (11, one % (1, 2)),
        (12, f"[{one % (2, 1)}]"),
        (13, f"[{one % (2, 5)}]"),
        (14, f"[{one % (1, 99999999999)}, {one % (1, 99999999999)}]"),
        (15, '[{"product_id": 1, "quantity": 1000, "unit_price": 99999999999}]'),
    ]
    documents = [(i, 99 if i == 99 else 1, 77 if i == 12 else 1) for i in [*range(1, 16), 99]]
    sold = sales.create_sales(
        spark.createDataFrame(documents, "doc_id long, customer_id long, account_id long"),
        spark.createDataFrame(pages, "doc_id long, items_json string"),
        books["customers"], books["products"], shelf, books["cash_accounts"], AS_OF)
    # 9: a free sale is refused by the cash posting and so leaves its stock to 11; 12: unknown account.
    assert codes(sold["outcome"], "doc_id") == {
        1: None, 2: 53002, 3: 53003, 4: 53004, 5: 53004, 6: 53005, 7: 53006, 8: 53007, 9: 50001, 10: 53007, 11: None,
        12: 50003, 13: None, 14: 8115, 15: 8115, 99: 53001}
    left = {r.product_id: r.quantity for r in sold["finished_inventory"].collect()}
    assert left == {1: D("0.000"), 2: D("0.000")}
    assert {r.sales_id: r.total_amount for r in sold["sales_orders"].collect()} == {
        1: D("68000.00"), 11: D("17000.00"), 13: D("82500.00")}
    assert sold["sales_order_items"].count() == 4
    assert sold["sales_order_items"].filter("unit_cost = 3").count() == 3


def test_payroll(spark, books):
    nothing = payroll.pay_payroll("2026-05-01", rows(spark, "payroll", []), books["cash_accounts"], 1, AS_OF)
    assert nothing["outcome"].first().reason_code == 54001
    pay = payroll.merge_payroll(
        rows(spark, "payroll", []),
        payroll.calculate_payroll("2026-01-31", books["employees"], books["positions"], books["timesheets"]))
    poor = books["cash_accounts"].selectExpr("account_id", "cast(100 as decimal(14,2)) balance")
    short = payroll.pay_payroll("2026-01-01", pay, poor, 1, AS_OF)
    assert short["outcome"].first().reason_code == 50005
    assert short["payroll"].filter("status = 'paid'").count() == 0
    paid = payroll.pay_payroll("2026-01-09", pay, books["cash_accounts"], 1, AS_OF)
    assert paid["payroll"].filter("status = 'paid'").count() == 5
    again = payroll.calculate_payroll("2026-01-01", books["employees"], books["positions"], books["timesheets"])
    assert payroll.merge_payroll(paid["payroll"], again).filter("status = 'paid' or paid_date is not null").count() == 0
    assert payroll.merge_payroll(paid["payroll"], again, protect_paid=True).filter("status = 'paid'").count() == 5


def test_payroll_floor(spark, books):
    sheet = rows(spark, "timesheets", [(1, TODAY.replace(day=1), 1, D(0), D("99999"))],
                 "employee_id period_month worked_days bonus deductions")
    pay = payroll.calculate_payroll(AS_OF, books["employees"], books["positions"], sheet)
    got = {r.employee_id: (r.gross_salary, r.net_salary) for r in pay.collect()}
    assert got[1] == (D(0), D(0)) and got[2] == (D("210000.00"), D("189000.00"))


def test_credit(spark, books):
    schema = ("loan_id long, bank_name string, principal_amount decimal(14,2), interest_rate decimal(7,4), term_months int, "
              "start_date date, account_id long")
    loan = credit.take_loans(spark.createDataFrame([
        (1, "B", D(0), D(1), 12, TODAY, 1), (2, "B", D(100), D(-1), 12, TODAY, 1), (3, "B", D(100), D(1), 0, TODAY, 1),
        (4, "B", D(100), D(1), None, TODAY, 1), (5, "B", D("100.00"), D(0), 3, None, 1), (6, "B", D(100), D(1), 3, TODAY, 7),
        (7, "B", D("0.02"), D(0), 4, TODAY, 1)], schema),
        books["cash_accounts"], AS_OF)
    assert codes(loan["outcome"], "loan_id") == {1: 55001, 2: 55002, 3: 55003, 4: 55003, 5: None, 6: 50003, 7: None}
    plan = {(r.loan_id, r.installment_no): r.principal_due for r in loan["loan_schedule"].collect()}
    assert [plan[5, i] for i in (1, 2, 3)] == [D("33.33"), D("33.33"), D("33.34")]
    # 0.02 over 4 months pays 0.01 twice; nothing is left to pay afterwards.
    assert [plan[7, i] for i in (1, 2, 3, 4)] == [D("0.01"), D("0.01"), D("0.00"), D("0.00")]
    assert loan["cash_accounts"].first().balance == D("15000100.02")
    first = credit.pay_instalments(
        spark.createDataFrame([(1, 5, 3, 1), (2, 5, 9, 1), (3, 7, 3, 1), (4, 5, 3, 1), (5, None, 3, 1), (6, 5, None, 1), (7, None, 3, 1)], "seq long, loan_id long, installment_no int, account_id long"),
        loan["loans"], loan["loan_schedule"], loan["cash_accounts"], AS_OF)
    assert {r.seq: r.reason_code for r in first["outcome"].collect()} == {
        1: None, 2: 55005, 3: 50001, 4: 55004, 5: 55005, 6: 55005, 7: 55005}
    assert first["deferred"].count() == 0
    rest = credit.pay_instalments(
        spark.createDataFrame([(1, 5, 1, 1), (2, 5, 2, 1), (3, 5, 3, 1)], "seq long, loan_id long, installment_no int, account_id long"),
        first["loans"], first["loan_schedule"], first["cash_accounts"], AS_OF)
    assert {r.seq: r.reason_code for r in rest["outcome"].collect()} == {1: None, 2: None, 3: 55004}
    assert {r.loan_id: (r.status, r.current_principal) for r in rest["loans"].collect()} == {
        5: ("closed", D("0.00")), 7: ("active", D("0.02"))}


def test_instalment_requests_are_computed_once(spark, books):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "seq long, loan_id long, installment_no int, account_id long"
    requests = spark.createDataFrame([(1, 5, 1, 1), (2, 5, 1, 1), (3, 5, 2, 1), (4, None, 2, 1)], schema).mapInArrow(note, schema)
    loans = spark.createDataFrame([(5, D("100.00"), D(0), 3, TODAY, "active", D("100.00"))], "loan_id long, principal_amount decimal(14,2), "
                                  "interest_rate decimal(7,4), term_months int, start_date date, status string, current_principal decimal(14,2)")
    plan = credit.build_schedule(loans).selectExpr("*", "false paid", "cast(null as date) paid_at")
    paid = credit.pay_instalments(requests, loans, plan, books["cash_accounts"], AS_OF)
    assert {r.seq: r.reason_code for r in paid["outcome"].collect()} == {1: None, 2: 55004, 3: None, 4: 55005}
    assert seen.value == 4


def test_sales_beyond_the_opening_stock_and_unsold_pages_are_left_early(spark, books, monkeypatch):
    """Acceptance gets no document that the opening stock refuses; only pages of sold documents are read for items."""
    offered = []

    def accept(needs):
        offered.extend(r.seq for r in needs.collect())
        return accept_in_order(needs)

    monkeypatch.setattr(sales, "accept_in_order", accept)
    shelf = rows(spark, "finished_inventory", [(1, D("10"), D("3.00"))], "product_id quantity avg_cost")
    one = '[{"product_id": 1, "quantity": %s}]'
    pages = [(1, one % 11), (2, one % 6), (3, one % 5), (4, one % 4), (4, one % 0.5), (5, "[]"), (5, one % 11)]
    sold = sales.create_sales(
        spark.createDataFrame([(i, 1, 77 if i == 3 else 1) for i in range(1, 6)], "doc_id long, customer_id long, account_id long"),
        spark.createDataFrame(pages, "doc_id long, items_json string"),
        books["customers"], books["products"], shelf, books["cash_accounts"], AS_OF)
    assert codes(sold["outcome"], "doc_id") == {1: 53007, 2: None, 3: 53007, 4: 53007, 5: 53007}
    assert sorted(offered) == [2, 3, 4]
    plan = sold["sales_order_items"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # parsed above the join
