"""SQL twins of the registered queries, for DuckDB over the same star-schema views.

Division is done on whole numbers (``//``), because decimal division is double there.
"""

from __future__ import annotations

import re

from tallyworks.operators import quality
from tallyworks.plans.queries import AS_OF, PERIOD
from tallyworks.sources.adapters import OPENING_CASH, PAID_UNTIL

# Named sub-queries; a twin lists the ones it uses and their own parts are pulled in.
PARTS: dict[str, str] = {
    "lines": """
        SELECT l_orderkey AS doc_id, l_partkey AS item, l_suppkey,
               CAST(l_shipdate AS DATE) AS ship_date, l_discount, l_returnflag,
               CAST(l_quantity AS DECIMAL(14,3)) AS quantity,
               CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                    // (2 * CAST(l_quantity AS BIGINT)) * 0.01 AS DECIMAL(14,2)) AS unit_price,
               coalesce(CASE WHEN l_tax = 0 THEN CAST(round(l_discount * 100) AS INTEGER) END, 0) AS defect
        FROM lineitem""",
    "amounts": """
        SELECT *, CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(38,5)) AS amount
        FROM lines""",
    "items": """
        SELECT doc_id, CASE WHEN defect = 3 THEN -item - 1 ELSE item END AS item,
               CAST(CASE WHEN defect = 2 THEN 0 ELSE quantity END AS DECIMAL(14,3)) AS quantity,
               unit_price, l_discount
        FROM lines WHERE defect NOT IN (1, 4)""",
    "pages": """
        SELECT doc_id, max(CASE WHEN defect = 1 THEN 1 ELSE 0 END) AS bad_json,
               count(*) FILTER (defect NOT IN (1, 4)) AS n_items,
               max(CASE WHEN defect = 2 THEN 1 ELSE 0 END) AS bad_value,
               max(CASE WHEN defect = 3 THEN 1 ELSE 0 END) AS unknown,
               min(l_suppkey) AS supplier_id
        FROM lines GROUP BY doc_id""",
    "stock": """
        SELECT p_partkey AS item, CAST((p_partkey % 13) * 25 AS DECIMAL(14,3)) AS quantity,
               CAST((CAST(round(p_retailprice * 100) AS BIGINT) + 1) // 2 * 0.01 AS DECIMAL(14,2)) AS avg_cost
        FROM part WHERE p_size % 7 <> 0""",
    "purchases": """
        SELECT o_orderkey AS purchase_id, supplier_id, CAST(o_orderdate AS DATE) AS order_date,
               CASE o_orderstatus WHEN 'F' THEN 'received' WHEN 'O' THEN 'ordered' ELSE 'cancelled' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN last_ship END AS received_date, total_amount
        FROM orders JOIN (
            SELECT doc_id, min(l_suppkey) AS supplier_id, max(ship_date) AS last_ship,
                   CAST(round(sum(amount), 2) AS DECIMAL(14,2)) AS total_amount
            FROM amounts GROUP BY doc_id) ON doc_id = o_orderkey""",
    "recipe": """
        SELECT p_partkey AS product_id, xor(p_partkey, k) AS item, qty
        FROM part, (VALUES (CAST(0 AS BIGINT), 0.250), (CAST(1 AS BIGINT), 0.500), (CAST(2 AS BIGINT), 0.375)) v(k, qty)
        WHERE p_size < 50""",
    "runs": """
        SELECT o_orderkey AS run, o_custkey AS product_id, CAST(o_orderdate AS DATE) AS order_date,
               CAST(1 + CAST(trunc(o_totalprice) AS BIGINT) % 50 AS DECIMAL(14,3)) AS quantity
        FROM orders""",
    "needs": """
        SELECT run, product_id, r.item,
               CAST(round(CAST(qty AS DECIMAL(14,3)) * runs.quantity, 3) AS DECIMAL(14,3)) AS required,
               CAST(coalesce(avg_cost, 0) AS DECIMAL(14,2)) AS unit_cost, stock.quantity AS stock_qty
        FROM runs JOIN recipe r USING (product_id) LEFT JOIN stock ON stock.item = r.item""",
    "run_costs": """
        SELECT run, CAST(round(sum(CAST(CAST(required AS DECIMAL(18,3)) * CAST(unit_cost AS DECIMAL(18,2)) AS DECIMAL(38,5))), 2)
                         AS DECIMAL(14,2)) AS total_cost
        FROM needs GROUP BY run""",
    "run_claims": """
        SELECT run AS seq, item AS key, required AS need, stock_qty AS stock
        FROM needs WHERE run NOT IN (SELECT run FROM needs WHERE stock_qty IS NULL)""",
    "run_waves": """
        SELECT seq, key, need, stock AS available, 'open' AS state FROM run_claims
        UNION ALL
        SELECT seq, key, need, remaining,
               CASE WHEN bool_or(need > remaining) OVER (PARTITION BY seq) THEN 'refused'
                    WHEN bool_and(waiting + need <= remaining) OVER (PARTITION BY seq) THEN 'accepted'
                    ELSE 'open' END
        FROM (SELECT *, available - taken AS remaining
              FROM (SELECT *,
                           coalesce(sum(CASE WHEN state = 'accepted' THEN need ELSE 0 END) OVER w, 0) AS taken,
                           coalesce(sum(CASE WHEN state = 'open' THEN need ELSE 0 END) OVER w, 0) AS waiting
                    FROM run_waves WHERE state <> 'refused'
                    WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
        WHERE state = 'open'""",
    "run_codes": """
        SELECT runs.run, product_id, runs.quantity,
               CASE WHEN n.run IS NULL THEN 52003 WHEN no_stock THEN 52004 WHEN w.state = 'refused' THEN 52005 END AS reason_code
        FROM runs
        LEFT JOIN (SELECT run, bool_or(stock_qty IS NULL) AS no_stock FROM needs GROUP BY run) n ON n.run = runs.run
        LEFT JOIN (SELECT DISTINCT seq, state FROM run_waves WHERE state <> 'open') w ON w.seq = runs.run""",
    "sale_checks": """
        SELECT o_orderkey AS doc_id, o_custkey AS customer_id,
               CASE WHEN bad_json = 1 THEN 53002 WHEN coalesce(n_items, 0) = 0 THEN 53003 WHEN bad_value = 1 THEN 53004
                    WHEN unknown = 1 THEN 53005 WHEN no_stock THEN 53006 END AS code
        FROM orders LEFT JOIN pages ON pages.doc_id = o_orderkey
        LEFT JOIN (SELECT items.doc_id, bool_or(stock.item IS NULL) AS no_stock
                   FROM items LEFT JOIN stock USING (item) GROUP BY items.doc_id) s ON s.doc_id = o_orderkey""",
    "sale_claims": """
        SELECT doc_id AS seq, item AS key, sum(items.quantity) AS need, any_value(stock.quantity) AS stock
        FROM items JOIN stock USING (item)
        WHERE doc_id IN (SELECT doc_id FROM sale_checks WHERE code IS NULL)
        GROUP BY doc_id, item""",
    "sale_codes": """
        SELECT doc_id, customer_id, coalesce(code, CASE WHEN w.state = 'refused' THEN 53007 END) AS reason_code
        FROM sale_checks
        LEFT JOIN (SELECT DISTINCT seq, state FROM sale_waves WHERE state <> 'open') w ON w.seq = doc_id""",
    "timesheets": """
        SELECT user_id AS employee_id, CAST(date_trunc('month', ts) AS DATE) AS period_month,
               CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS worked_days,
               CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END), 0)
                    AS DECIMAL(14,2)) AS bonus,
               CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(14,2)) END), 0)
                    AS DECIMAL(14,2)) AS deductions
        FROM events GROUP BY 1, 2""",
    "months": "SELECT * FROM (VALUES (DATE '2024-01-01'), (DATE '2024-02-01')) v(period_month)",
    "gross": """
        SELECT c_custkey AS employee_id, m.period_month, c_mktsegment,
               CAST(greatest(round(
                   CAST((200000 + 10000 * CAST(n_nationkey AS BIGINT)) * 1000000 // 22 * 0.000001 AS DECIMAL(24,6))
                   * coalesce(worked_days, 22) + coalesce(bonus, 0) - coalesce(deductions, 0), 2), 0)
                   AS DECIMAL(14,2)) AS gross_salary
        FROM customer JOIN nation ON n_nationkey = c_nationkey, months m
        LEFT JOIN timesheets t ON t.employee_id = c_custkey AND t.period_month = m.period_month
        WHERE c_acctbal >= 0""",
    "taxed": """
        SELECT *, CAST(round(gross_salary * 0.10, 2) AS DECIMAL(14,2)) AS tax_amount,
               CAST(gross_salary - CAST(round(gross_salary * 0.10, 2) AS DECIMAL(14,2)) AS DECIMAL(14,2)) AS net_salary
        FROM gross""",
    "payroll": """
        SELECT employee_id, period_month, gross_salary, tax_amount, net_salary,
               CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'paid' ELSE 'calculated' END AS status,
               CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(last_day(period_month) AS DATE) END AS paid_date
        FROM taxed""",
    "loans": """
        SELECT o_orderkey AS loan_id, o_orderpriority AS bank_name, CAST(o_orderdate AS DATE) AS start_date, o_custkey,
               CAST(o_totalprice AS DECIMAL(14,2)) AS principal_amount,
               CAST(round(o_totalprice * 100) AS HUGEINT) AS principal_c,
               CAST(o_custkey % 25 AS DECIMAL(7,4)) AS interest_rate,
               CAST(6 + o_custkey % 19 AS INTEGER) AS term_months,
               (2 * CAST(o_custkey % 25 AS HUGEINT) * 10000000000 + 1200) // 2400 AS rate_u
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "priced_loans": """
        SELECT *, CASE WHEN rate_u = 0 THEN (2 * principal_c + term_months) // (2 * term_months)
                       ELSE (2 * principal_c * rate_u + share_u) // (2 * share_u) END AS payment_c
        FROM (SELECT *, 10000000000 - CAST(round(CAST(pow(1 + CAST(rate_u AS DOUBLE) / 10000000000, -term_months) AS DOUBLE)
                             * 10000000000) AS HUGEINT) AS share_u FROM loans)""",
    "plan": """
        SELECT loan_id, 0 AS no, CAST(0 AS HUGEINT) AS principal_due, CAST(0 AS HUGEINT) AS interest_due,
               principal_c AS remaining FROM priced_loans
        UNION ALL
        SELECT loan_id, no, principal_due, interest_due, remaining - principal_due
        FROM (SELECT *, CASE WHEN no = term_months OR payment_c - interest_due > remaining THEN remaining
                             ELSE payment_c - interest_due END AS principal_due
              FROM (SELECT p.loan_id, p.no + 1 AS no, p.remaining, l.term_months, l.payment_c,
                           (2 * p.remaining * l.rate_u + 10000000000) // 20000000000 AS interest_due
                    FROM plan p JOIN priced_loans l ON l.loan_id = p.loan_id WHERE p.no < l.term_months))""",
    "schedule": """
        SELECT loan_id, CAST(no AS INTEGER) AS installment_no,
               CAST(start_date + to_months(CAST(no AS INTEGER)) AS DATE) AS due_date,
               CAST(CAST(principal_due AS BIGINT) * 0.01 AS DECIMAL(14,2)) AS principal_due,
               CAST(CAST(interest_due AS BIGINT) * 0.01 AS DECIMAL(14,2)) AS interest_due
        FROM plan JOIN loans USING (loan_id) WHERE no > 0""",
    "settled": f"""
        SELECT loan_id, bank_name, start_date, principal_amount, interest_rate, term_months,
               CASE WHEN principal_amount - coalesce(paid, 0) <= 0 THEN 'closed' ELSE 'active' END AS status,
               CAST(greatest(principal_amount - coalesce(paid, 0), 0) AS DECIMAL(14,2)) AS current_principal
        FROM loans LEFT JOIN (SELECT loan_id, sum(principal_due) AS paid FROM schedule
                              WHERE due_date <= DATE '{PAID_UNTIL}' GROUP BY loan_id) USING (loan_id)""",
    "moves": """
        SELECT event_id AS seq, user_id AS account_id,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'in' ELSE 'out' END AS direction,
               CAST(value AS DECIMAL(14,2)) AS amount, ts FROM events""",
    "opening": """
        SELECT c_custkey AS account_id, CAST(greatest(CAST(c_acctbal AS DECIMAL(14,2)), 0) AS DECIMAL(14,2)) AS balance
        FROM customer""",
    "cash_steps": """
        SELECT account_id, seq, CASE WHEN direction = 'in' THEN amount ELSE -amount END AS change, balance AS opening,
               row_number() OVER (PARTITION BY account_id ORDER BY seq) AS n
        FROM moves JOIN opening USING (account_id) WHERE amount > 0""",
    "receipt_steps": """
        SELECT CAST(s_nationkey AS BIGINT) AS account_id, purchase_id AS seq, -total_amount AS change,
               CAST(20000000 AS DECIMAL(14,2)) AS opening,
               row_number() OVER (PARTITION BY s_nationkey ORDER BY purchase_id) AS n
        FROM purchases JOIN supplier ON s_suppkey = supplier_id WHERE status = 'ordered'""",
    "due": f"""
        SELECT loan_id, installment_no, due_date, principal_due, interest_due, CAST(c_nationkey AS BIGINT) AS account_id,
               row_number() OVER (ORDER BY due_date, loan_id, installment_no) AS seq
        FROM schedule JOIN loans USING (loan_id) JOIN customer ON c_custkey = o_custkey
        WHERE due_date <= DATE '{PAID_UNTIL}'""",
    "due_steps": """
        SELECT account_id, seq, -(principal_due + interest_due) AS change, CAST(5000000 AS DECIMAL(14,2)) AS opening,
               row_number() OVER (PARTITION BY account_id ORDER BY seq) AS n
        FROM due WHERE principal_due + interest_due > 0""",
    "receipts": """
        SELECT doc_id AS seq, item, sum(quantity) AS qty, sum(amount) AS cost,
               row_number() OVER (PARTITION BY item ORDER BY doc_id) AS n
        FROM amounts WHERE doc_id IN (SELECT seq FROM receipt_steps_done WHERE accepted)
        GROUP BY doc_id, item""",
    "finish": """
        SELECT run AS seq, product_id AS item, quantity AS qty, total_cost AS cost,
               row_number() OVER (PARTITION BY product_id ORDER BY run) AS n
        FROM run_codes JOIN run_costs USING (run) WHERE reason_code IS NULL""",
    "clicks": """
        SELECT user_id AS employee_id, CAST(date_trunc('month', ts) AS DATE) AS period_month,
               CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS worked_days, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS bonus
        FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
}
PARTS["sale_waves"] = PARTS["run_waves"].replace("run_waves", "sale_waves").replace("run_claims", "sale_claims")

# One account after the other: each step sees the balance the last one left.
for _steps in ("cash_steps", "receipt_steps", "due_steps"):
    PARTS[f"{_steps}_done"] = f"""
        SELECT account_id, seq, n, opening + change >= 0 OR change > 0 AS accepted,
               CAST(CASE WHEN opening + change >= 0 OR change > 0 THEN opening + change ELSE opening END AS DECIMAL(14,2)) AS balance
        FROM {_steps} WHERE n = 1
        UNION ALL
        SELECT s.account_id, s.seq, s.n, d.balance + s.change >= 0 OR s.change > 0,
               CAST(CASE WHEN d.balance + s.change >= 0 OR s.change > 0 THEN d.balance + s.change ELSE d.balance END AS DECIMAL(14,2))
        FROM {_steps}_done d JOIN {_steps} s ON s.account_id = d.account_id AND s.n = d.n + 1"""


def _after(pool: str, value: str) -> str:
    """Average cost in cents; pool in thousandths, value in hundred-thousandths."""
    return f"CASE WHEN {pool} = 0 THEN 0 ELSE (2 * ({value}) + {pool}) // (2 * {pool}) END"


for _rows in ("receipts", "finish"):
    PARTS[f"{_rows}_w"] = f"""
        SELECT item, seq, n, CAST(qty * 1000 AS HUGEINT) AS q, CAST(CAST(cost AS DECIMAL(38,5)) * 100000 AS HUGEINT) AS c
        FROM {_rows}"""
    PARTS[f"{_rows}_avg"] = f"""
        SELECT item, CAST(0 AS BIGINT) AS n, CAST(coalesce(quantity, 0) * 1000 AS HUGEINT) AS q,
               CAST(coalesce(avg_cost, 0) * 100 AS HUGEINT) AS a
        FROM (SELECT DISTINCT item FROM {_rows}) LEFT JOIN stock USING (item)
        UNION ALL
        SELECT item, n, q, a FROM (
            SELECT w.item, w.n, s.q + w.q AS q, {_after("(s.q + w.q)", "s.q * s.a + w.c")} AS a
            FROM {_rows}_avg s JOIN {_rows}_w w ON w.item = s.item AND w.n = s.n + 1)"""
    PARTS[f"{_rows}_stock"] = f"""
        SELECT item, CAST(CAST(q AS DECIMAL(38,0)) * 0.001 AS DECIMAL(14,3)) AS quantity,
               CAST(CAST(a AS DECIMAL(38,0)) * 0.01 AS DECIMAL(14,2)) AS avg_cost
        FROM (SELECT item, q, a, row_number() OVER (PARTITION BY item ORDER BY n DESC) AS last FROM {_rows}_avg)
        WHERE last = 1
        UNION ALL
        SELECT item, quantity, avg_cost FROM stock WHERE item NOT IN (SELECT item FROM {_rows})"""


def _sql(body: str) -> str:
    """The query with the parts it names, in order of dependency."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in PARTS:
            if name not in path and name not in ordered and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(PARTS[name], (*path, name))
                ordered.append(name)

    visit(body, ())
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered) + body


PARTS["sheets"] = """
    SELECT user_id AS employee_id, CAST(date_trunc('month', ts) AS DATE) AS period_month, event_type AS work,
           CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS worked_days
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3"""
PARTS["grants"] = """
    SELECT o_orderkey AS loan_id, o_totalprice, CASE WHEN o_orderkey % 50 = 4 THEN 99 ELSE c_nationkey END AS account_id,
           CASE o_orderkey % 50 WHEN 1 THEN 55001 WHEN 2 THEN 55002 WHEN 3 THEN 55003 WHEN 4 THEN 50003 END AS code
    FROM orders JOIN customer ON c_custkey = o_custkey"""
PARTS["card_events"] = """
    SELECT item, 2 * doc_id + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS seq, l_returnflag = 'R' AS issue,
           CAST(sum(quantity) AS DECIMAL(14,3)) AS qty, CAST(sum(amount) AS DECIMAL(38,5)) AS cost
    FROM amounts GROUP BY 1, 2, 3"""
PARTS["card_order"] = """
    SELECT *, CAST(qty * 1000 AS HUGEINT) AS q1, CAST(CASE WHEN issue THEN 0 ELSE cost * 100000 END AS HUGEINT) AS c1,
           row_number() OVER (PARTITION BY item ORDER BY seq) AS n
    FROM card_events"""
PARTS["card_steps"] = f"""
    SELECT i.item, CAST(0 AS BIGINT) AS n, CAST(coalesce(stock.quantity, 0) * 1000 AS HUGEINT) AS q0,
           CAST(coalesce(avg_cost, 0) * 100 AS HUGEINT) AS a0, true AS passed
    FROM (SELECT DISTINCT item FROM card_events) i LEFT JOIN stock ON stock.item = i.item
    UNION ALL
    SELECT s.item, o.n, CASE WHEN NOT issue THEN q0 + q1 WHEN q1 <= q0 THEN q0 - q1 ELSE q0 END,
           CASE WHEN issue THEN a0 ELSE {_after("(q0 + q1)", "q0 * a0 + c1")} END, NOT issue OR q1 <= q0
    FROM card_steps s JOIN card_order o ON o.item = s.item AND o.n = s.n + 1"""
_CARD_QUANTITY = "CAST(CAST(q0 AS DECIMAL(38,0)) * 0.001 AS DECIMAL(14,3))"
_CARD_AVERAGE = "CAST(CAST(a0 AS DECIMAL(38,0)) * 0.01 AS DECIMAL(14,2))"

# The audited tables, with the columns that the mappings supply.
AUDITED: dict[str, str] = {
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier WHERE s_acctbal >= 0",
    "raw_materials": """SELECT p_partkey AS raw_material_id, p_name AS material_name, p_type AS unit,
        CAST(p_size * 10 AS DECIMAL(14,3)) AS min_stock FROM part""",
    "raw_inventory": "SELECT item AS raw_material_id, quantity, avg_cost FROM stock",
    "cash_accounts": """SELECT c_custkey AS account_id, c_name AS account_name, balance, 'KZT' AS currency_code
        FROM customer JOIN opening ON account_id = c_custkey""",
    "cash_movements": """SELECT event_id AS movement_id, m.ts AS movement_date, account_id, direction, amount, event_type AS category
        FROM moves m JOIN events ON event_id = seq""",
    "purchase_orders": "SELECT * FROM purchases",
    "purchase_order_items": "SELECT doc_id AS purchase_id, item AS raw_material_id, quantity, unit_price FROM items",
    "products": """SELECT p_partkey AS product_id, p_brand AS sku, p_name AS product_name, p_type AS category,
        CAST(p_retailprice AS DECIMAL(14,2)) AS sale_price, CAST(0 AS DECIMAL(14,2)) AS standard_cost FROM part""",
    "bill_of_materials": "SELECT product_id, item AS raw_material_id, qty AS qty_per_unit FROM recipe",
    "production_orders": """SELECT run AS production_order_id, product_id, order_date, quantity AS planned_qty,
        'planned' AS status FROM runs""",
    "production_consumption": """SELECT run AS production_order_id, item AS raw_material_id, required AS quantity, unit_cost
        FROM needs""",
    "finished_inventory": "SELECT item AS product_id, quantity, avg_cost FROM stock",
    "customers": "SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer",
    "sales_orders": """SELECT o_orderkey AS sales_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS sales_date,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'draft' ELSE 'cancelled' END AS status FROM orders""",
    "sales_order_items": """SELECT doc_id AS sales_id, item AS product_id, quantity, unit_price,
        CAST(round(unit_price * 0.6, 2) AS DECIMAL(14,2)) AS unit_cost FROM lines""",
    "departments": "SELECT r_regionkey AS department_id, r_name AS department_name FROM region",
    "positions": """SELECT n_nationkey AS position_id, n_regionkey AS department_id, n_name AS position_name,
        200000 + 10000 * n_nationkey AS base_salary FROM nation""",
    "employees": """SELECT c_custkey AS employee_id, c_name AS full_name, c_nationkey AS position_id,
        c_acctbal >= 0 AS is_active FROM customer""",
    "timesheets": "SELECT * FROM timesheets",
    "payroll": "SELECT * FROM payroll",
    "loans": """SELECT loan_id, bank_name, start_date, principal_amount, interest_rate, term_months, 'active' AS status,
        principal_amount AS current_principal FROM loans""",
    "loan_schedule": f"""SELECT *, due_date <= DATE '{PAID_UNTIL}' AS paid,
        CASE WHEN due_date <= DATE '{PAID_UNTIL}' THEN due_date END AS paid_at FROM schedule""",
    "loan_payments": f"""SELECT loan_id, due_date AS payment_date, principal_due AS principal_paid,
        interest_due AS interest_paid FROM schedule WHERE due_date <= DATE '{PAID_UNTIL}'""",
}
# Columns of the audited tables, for the names of their rules.
AUDITED_COLUMNS: dict[str, str] = {
    "suppliers": "supplier_id supplier_name",
    "raw_materials": "raw_material_id material_name unit min_stock",
    "raw_inventory": "raw_material_id quantity avg_cost",
    "cash_accounts": "account_id account_name balance currency_code",
    "cash_movements": "movement_id movement_date account_id direction amount category",
    "purchase_orders": "purchase_id supplier_id order_date status received_date total_amount",
    "purchase_order_items": "purchase_id raw_material_id quantity unit_price",
    "products": "product_id sku product_name category sale_price standard_cost",
    "bill_of_materials": "product_id raw_material_id qty_per_unit",
    "production_orders": "production_order_id product_id order_date planned_qty status",
    "production_consumption": "production_order_id raw_material_id quantity unit_cost",
    "finished_inventory": "product_id quantity avg_cost",
    "customers": "customer_id customer_name",
    "sales_orders": "sales_id customer_id sales_date status",
    "sales_order_items": "sales_id product_id quantity unit_price unit_cost",
    "departments": "department_id department_name",
    "positions": "position_id department_id position_name base_salary",
    "employees": "employee_id full_name position_id is_active",
    "timesheets": "employee_id period_month worked_days bonus deductions",
    "payroll": "employee_id period_month gross_salary tax_amount net_salary status paid_date",
    "loans": "loan_id bank_name start_date principal_amount interest_rate term_months status current_principal",
    "loan_schedule": "loan_id installment_no due_date principal_due interest_due paid paid_at",
    "loan_payments": "loan_id payment_date principal_paid interest_paid",
}
for _table, _select in AUDITED.items():
    PARTS[f"audited_{_table}"] = _select


def _audit_rules() -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS row_count FROM audited_{table} WHERE NOT ({condition})"
        for table, columns in AUDITED_COLUMNS.items()
        for rule, condition in quality.conditions(table, columns.split()).items()
    )


def _audit_references() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{child}.{column}' AS reference, count(*) AS row_count FROM audited_{child} c
            WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM audited_{parent} p WHERE p.{column} = c.{column})"""
        for (child, column), parent in quality.REFERENCES.items()
        if column in AUDITED_COLUMNS.get(child, "").split() and parent in AUDITED_COLUMNS
    )


def _audit_keys() -> str:
    lists = [
        (table, columns)
        for table, given in AUDITED_COLUMNS.items()
        for columns in [quality.PRIMARY.get(table, [""]), *quality.UNIQUE.get(table, [])]
        if set(columns) <= set(given.split())
    ]
    return " UNION ALL ".join(
        f"""SELECT '{table}({", ".join(columns)})' AS unique_key, count(*) AS repeated_keys,
            CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count
            FROM (SELECT count(*) AS n FROM audited_{table} GROUP BY {", ".join(columns)} HAVING count(*) > 1)"""
        for table, columns in lists
    )


_TOTAL = "CAST(round(coalesce({}, 0), 2) AS DECIMAL(38,2))"
_NONE = "CAST(NULL AS DECIMAL(38,5))"
_FLOWS = f"""
    SELECT CAST(o_orderdate AS DATE) AS d, amount AS revenue,
           CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(round(unit_price * 0.6, 2) AS DECIMAL(18,2)) AS DECIMAL(38,5)) AS cogs,
           {_NONE} AS purchase, {_NONE} AS pay, {_NONE} AS interest
    FROM orders JOIN amounts ON doc_id = o_orderkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT received_date, NULL, NULL, total_amount, NULL, NULL FROM purchases WHERE status = 'received'
    UNION ALL SELECT paid_date, NULL, NULL, NULL, net_salary, NULL FROM payroll WHERE status = 'paid'
    UNION ALL SELECT due_date, NULL, NULL, NULL, NULL, interest_due FROM schedule WHERE due_date <= DATE '{PAID_UNTIL}'"""
PARTS["flows"] = _FLOWS
_FLOW_SUMS = ", ".join(
    f"{_TOTAL.format(f'sum({c})')} AS {a}"
    for c, a in (
        ("revenue", "revenue"),
        ("cogs", "cogs"),
        ("purchase", "purchase_expense"),
        ("pay", "payroll_expense"),
        ("interest", "loan_interest_expense"),
    )
)
_PROFITS = """CAST(revenue - cogs AS DECIMAL(38,2)) AS gross_profit, purchase_expense, payroll_expense,
    loan_interest_expense,
    CAST(revenue - cogs - payroll_expense - loan_interest_expense AS DECIMAL(38,2)) AS operating_profit"""

_BODIES: dict[str, str] = {
    "cash_ledger": """
        SELECT seq, account_id, direction, amount, CASE WHEN amount <= 0 THEN 50001 WHEN NOT accepted THEN 50005 END AS reason_code,
               balance AS balance_after
        FROM moves LEFT JOIN cash_steps_done USING (account_id, seq)""",
    "cash_balances": """
        SELECT account_id, coalesce(last_balance, opening.balance) AS balance
        FROM opening LEFT JOIN (SELECT account_id, max_by(balance, n) AS last_balance FROM cash_steps_done
                                GROUP BY account_id) USING (account_id)""",
    "cash_running_balance": """
        SELECT seq, account_id, direction, amount,
               CAST(balance + sum(CASE WHEN direction = 'in' THEN amount ELSE -amount END)
                    OVER (PARTITION BY account_id ORDER BY seq) AS DECIMAL(38,2)) AS running_balance
        FROM moves JOIN opening USING (account_id)""",
    "cash_movement_keys": """
        SELECT 1000 + row_number() OVER (ORDER BY ts, seq) AS movement_id, seq, account_id, CAST(ts AS DATE) AS day
        FROM moves""",
    "purchase_order_build": """
        SELECT doc_id, supplier_id, order_date, reason_code, CASE WHEN reason_code IS NULL THEN total_amount END AS total_amount
        FROM (SELECT o_orderkey AS doc_id, p.supplier_id, CAST(o_orderdate AS DATE) AS order_date,
                     CASE WHEN s_suppkey IS NULL THEN 51001 WHEN bad_json = 1 THEN 51002 WHEN coalesce(n_items, 0) = 0 THEN 51003
                          WHEN bad_value = 1 THEN 51004 WHEN unknown = 1 THEN 51005 END AS reason_code, t.total_amount
              FROM orders LEFT JOIN pages p ON p.doc_id = o_orderkey
              LEFT JOIN supplier ON s_suppkey = p.supplier_id AND s_acctbal >= 0
              LEFT JOIN (SELECT doc_id, CAST(round(sum(CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(unit_price AS DECIMAL(18,2))
                                AS DECIMAL(38,5))), 2) AS DECIMAL(14,2)) AS total_amount
                         FROM items GROUP BY doc_id) t ON t.doc_id = o_orderkey)""",
    "purchase_order_lines": """
        SELECT i.doc_id AS purchase_id, i.item AS raw_material_id, i.quantity, i.unit_price,
               CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(29,5)) AS line_total
        FROM items i JOIN pages p ON p.doc_id = i.doc_id
        JOIN supplier ON s_suppkey = p.supplier_id AND s_acctbal >= 0
        WHERE bad_json = 0 AND bad_value = 0 AND unknown = 0""",
    "purchase_receipt_by_material": """
        SELECT doc_id AS purchase_id, item AS raw_material_id, CAST(sum(quantity) AS DECIMAL(24,3)) AS qty,
               CAST(sum(amount) AS DECIMAL(38,5)) AS total_cost
        FROM amounts GROUP BY doc_id, item""",
    "purchase_receipt_outcome": """
        SELECT purchase_id, CASE WHEN status <> 'ordered' THEN 51007 WHEN NOT accepted THEN 50005 END AS reason_code
        FROM purchases LEFT JOIN receipt_steps_done ON seq = purchase_id""",
    "purchase_receipt_ledger": """
        SELECT seq AS movement_id, account_id, 'out' AS direction, CAST(-change AS DECIMAL(14,2)) AS amount, 'purchase' AS category,
               seq AS reference_id
        FROM receipt_steps JOIN receipt_steps_done USING (account_id, seq) WHERE accepted""",
    "cash_balances_after_receipt": """
        SELECT CAST(n_nationkey AS BIGINT) AS account_id, CAST(20000000 + coalesce(moved, 0) AS DECIMAL(14,2)) AS balance
        FROM nation LEFT JOIN (SELECT account_id, sum(change) AS moved FROM receipt_steps JOIN receipt_steps_done USING (account_id, seq)
                               WHERE accepted GROUP BY account_id) m ON m.account_id = n_nationkey""",
    "raw_inventory_after_receipt": """
        SELECT item AS raw_material_id, quantity, avg_cost FROM receipts_stock""",
    "stock_card": f"""
        SELECT seq, o.item AS raw_material_id, CASE WHEN issue THEN 'issue' ELSE 'receipt' END AS kind, qty,
               CASE WHEN NOT issue THEN cost END AS total_cost, CASE WHEN NOT passed THEN 52005 END AS reason_code,
               CASE WHEN passed THEN {_CARD_QUANTITY} END AS quantity_after,
               CASE WHEN passed THEN {_CARD_AVERAGE} END AS avg_cost_after,
               CASE WHEN passed AND issue THEN CAST(CAST(qty AS DECIMAL(18,3)) * CAST({_CARD_AVERAGE} AS DECIMAL(18,2)) AS DECIMAL(29,5)) END
                   AS issue_cost
        FROM card_order o JOIN card_steps s ON s.item = o.item AND s.n = o.n""",
    "raw_inventory_after_card": f"""
        SELECT coalesce(l.item, stock.item) AS raw_material_id,
               CASE WHEN l.moved THEN {_CARD_QUANTITY} ELSE stock.quantity END AS quantity,
               CASE WHEN l.moved THEN {_CARD_AVERAGE} ELSE stock.avg_cost END AS avg_cost
        FROM (SELECT item, max_by(q0, n) AS q0, max_by(a0, n) AS a0, true AS moved FROM card_steps
              GROUP BY item HAVING count(*) FILTER (passed AND n > 0) > 0) l
        FULL JOIN stock ON stock.item = l.item""",
    "inventory_merge_avg_cost": f"""
        SELECT item AS raw_material_id, CAST(CAST(q0 + q1 AS DECIMAL(38,0)) * 0.001 AS DECIMAL(14,3)) AS quantity,
               CAST(CAST({_after("(q0 + q1)", "q0 * a0 + c1")} AS DECIMAL(38,0)) * 0.01 AS DECIMAL(14,2)) AS avg_cost
        FROM (SELECT item, CAST(coalesce(stock.quantity, 0) * 1000 AS HUGEINT) AS q0, CAST(coalesce(avg_cost, 0) * 100 AS HUGEINT) AS a0,
                     CAST(coalesce(r.qty, 0) * 1000 AS HUGEINT) AS q1, CAST(coalesce(r.cost, 0) * 100000 AS HUGEINT) AS c1
              FROM stock FULL JOIN (SELECT item, sum(quantity) AS qty, sum(amount) AS cost FROM amounts GROUP BY item) r USING (item))""",
    "known_supplier_orders": """
        SELECT purchase_id, supplier_id, status, total_amount FROM purchases
        WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = supplier_id AND s_acctbal >= 0)""",
    "document_status_update": f"""
        SELECT purchase_id, CASE WHEN status = 'ordered' THEN 'received' ELSE status END AS status,
               CASE WHEN status = 'ordered' THEN DATE '{AS_OF}' ELSE received_date END AS received_date
        FROM purchases""",
    "bom_explosion": """
        SELECT run AS production_order_id, product_id, item AS raw_material_id, required AS required_qty, unit_cost, stock_qty
        FROM needs""",
    "production_cost": "SELECT run AS production_order_id, total_cost FROM run_costs",
    "production_shortage": """
        SELECT run AS production_order_id, item AS raw_material_id, required AS required_qty, stock_qty,
               CAST(required - stock_qty AS DECIMAL(14,3)) AS missing_qty
        FROM needs WHERE stock_qty < required""",
    "production_run_outcome": "SELECT run AS production_order_id, reason_code FROM run_codes",
    "raw_inventory_after_production": """
        SELECT stock.item AS raw_material_id, CAST(quantity - coalesce(used, 0) AS DECIMAL(14,3)) AS quantity, avg_cost
        FROM stock LEFT JOIN (SELECT item, sum(required) AS used FROM needs
                              WHERE run IN (SELECT run FROM run_codes WHERE reason_code IS NULL)
                              GROUP BY item) u ON u.item = stock.item""",
    "finished_inventory_after_production": "SELECT item AS product_id, quantity, avg_cost FROM finish_stock",
    "production_consumption": """
        SELECT run AS production_order_id, item AS raw_material_id, required AS quantity, unit_cost
        FROM needs WHERE run IN (SELECT run FROM run_codes WHERE reason_code IS NULL)""",
    "product_standard_costs": """
        SELECT p_partkey AS product_id, coalesce(cost, CAST(0 AS DECIMAL(14,2))) AS standard_cost
        FROM part LEFT JOIN (
            SELECT item, CAST(CAST((2 * CAST(max_by(cost, n) * 100 AS HUGEINT) * 1000 + CAST(max_by(qty, n) * 1000 AS HUGEINT))
                     // (2 * CAST(max_by(qty, n) * 1000 AS HUGEINT)) AS BIGINT) * 0.01 AS DECIMAL(14,2)) AS cost
            FROM finish GROUP BY item) f ON f.item = p_partkey""",
    "production_summary": """
        SELECT run AS production_order_id, order_date, order_date AS completion_date, 'completed' AS status,
               p_name AS product_name, quantity AS produced_qty, total_cost,
               CAST(CAST((2 * CAST(total_cost * 100 AS HUGEINT) * 1000 + CAST(quantity * 1000 AS HUGEINT))
                    // (2 * CAST(quantity * 1000 AS HUGEINT)) AS BIGINT) * 0.01 AS DECIMAL(14,2)) AS unit_cost
        FROM runs JOIN run_costs USING (run) JOIN part ON p_partkey = product_id""",
    "sale_lines_priced": """
        SELECT doc_id, item AS product_id, items.quantity,
               CASE WHEN l_discount <> 0 THEN unit_price ELSE CAST(p_retailprice AS DECIMAL(14,2)) END AS unit_price,
               avg_cost AS unit_cost
        FROM items JOIN part ON p_partkey = item JOIN stock USING (item)""",
    "sale_need_by_product": """
        SELECT doc_id, item AS product_id, CAST(sum(quantity) AS DECIMAL(14,3)) AS qty_needed FROM items GROUP BY doc_id, item""",
    "sale_outcome": "SELECT doc_id, customer_id, reason_code FROM sale_codes",
    "sale_items_sold": """
        SELECT doc_id AS sales_id, item AS product_id, items.quantity,
               CASE WHEN l_discount <> 0 THEN unit_price ELSE CAST(p_retailprice AS DECIMAL(14,2)) END AS unit_price,
               avg_cost AS unit_cost
        FROM items JOIN part ON p_partkey = item JOIN stock USING (item)
        WHERE doc_id IN (SELECT doc_id FROM sale_codes WHERE reason_code IS NULL)""",
    "sale_orders_created": """
        SELECT doc_id AS sales_id, customer_id, 'paid' AS status, total_amount
        FROM sale_codes JOIN (
            SELECT doc_id, CAST(round(sum(CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(
                       CASE WHEN l_discount <> 0 THEN unit_price ELSE CAST(p_retailprice AS DECIMAL(14,2)) END AS DECIMAL(18,2))
                       AS DECIMAL(38,5))), 2) AS DECIMAL(14,2)) AS total_amount
            FROM items JOIN part ON p_partkey = item GROUP BY doc_id) t USING (doc_id)
        WHERE reason_code IS NULL""",
    "sale_stock_after": """
        SELECT stock.item AS product_id, CAST(quantity - coalesce(sold, 0) AS DECIMAL(14,3)) AS quantity, avg_cost
        FROM stock LEFT JOIN (SELECT item, sum(quantity) AS sold FROM items
                              WHERE doc_id IN (SELECT doc_id FROM sale_codes WHERE reason_code IS NULL)
                              GROUP BY item) u ON u.item = stock.item""",
    "sales_summary": f"""
        SELECT o_orderkey AS sales_id, CAST(o_orderdate AS DATE) AS sales_date, c_name AS customer_name,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'draft' ELSE 'cancelled' END AS status,
               {_TOTAL.format("sum(amount)")} AS revenue,
               {_TOTAL.format("sum(cost)")} AS cogs,
               {_TOTAL.format("sum(amount - cost)")} AS gross_profit
        FROM orders JOIN customer ON c_custkey = o_custkey
        LEFT JOIN (SELECT doc_id, amount, CAST(CAST(quantity AS DECIMAL(18,3)) * CAST(round(unit_price * 0.6, 2) AS DECIMAL(18,2))
                          AS DECIMAL(38,5)) AS cost FROM amounts) s ON s.doc_id = o_orderkey
        GROUP BY o_orderkey, o_orderdate, c_name, o_orderstatus""",
    "payroll_calc": """
        SELECT employee_id, period_month, gross_salary, tax_amount, net_salary FROM taxed
        WHERE period_month = DATE '2024-01-01'""",
    "payroll_recalculated": """
        SELECT employee_id, period_month, gross_salary, tax_amount, net_salary,
               CASE WHEN period_month = DATE '2024-01-01' THEN 'calculated' ELSE status END AS status,
               CASE WHEN period_month = DATE '2024-01-01' THEN NULL ELSE paid_date END AS paid_date
        FROM payroll""",
    "payroll_payout": """
        SELECT employee_id, period_month, net_salary,
               CASE WHEN period_month = DATE '2024-01-01' THEN 'paid' ELSE status END AS status,
               CASE WHEN period_month = DATE '2024-01-01' AND status = 'calculated' THEN DATE '2024-02-05' ELSE paid_date END AS paid_date
        FROM payroll""",
    "monthly_payroll": """
        SELECT period_month, count(*) AS employees_count, CAST(sum(gross_salary) AS DECIMAL(38,2)) AS total_gross_salary,
               CAST(sum(tax_amount) AS DECIMAL(38,2)) AS total_tax, CAST(sum(net_salary) AS DECIMAL(38,2)) AS total_net_salary
        FROM payroll GROUP BY period_month""",
    "timesheet_upsert": """
        SELECT coalesce(s.employee_id, t.employee_id) AS employee_id, coalesce(s.period_month, t.period_month) AS period_month,
               coalesce(s.worked_days, t.worked_days) AS worked_days, coalesce(s.bonus, t.bonus) AS bonus,
               CAST(CASE WHEN s.employee_id IS NULL THEN t.deductions ELSE 0 END AS DECIMAL(14,2)) AS deductions
        FROM timesheets t FULL JOIN (
            SELECT * FROM clicks UNION ALL
            SELECT employee_id, CAST(period_month + INTERVAL 1 MONTH AS DATE), worked_days, bonus FROM clicks) s
        ON s.employee_id = t.employee_id AND s.period_month = t.period_month""",
    "timesheet_merge_refused": """
        SELECT employee_id, period_month, worked_days, 8672 AS reason_code
        FROM (SELECT *, count(*) OVER (PARTITION BY employee_id, period_month) AS n FROM sheets) WHERE n > 1""",
    "timesheet_merge_last": """
        SELECT coalesce(s.employee_id, t.employee_id) AS employee_id, coalesce(s.period_month, t.period_month) AS period_month,
               coalesce(s.worked_days, t.worked_days) AS worked_days, t.bonus, t.deductions
        FROM timesheets t FULL JOIN (SELECT employee_id, period_month, max_by(worked_days, work) AS worked_days FROM sheets GROUP BY 1, 2) s
        ON s.employee_id = t.employee_id AND s.period_month = t.period_month""",
    "loan_grants": "SELECT loan_id, code AS reason_code FROM grants",
    "loan_grant_balances": """
        SELECT CAST(n_nationkey AS BIGINT) AS account_id, CAST({opening} + coalesce(lent, 0) AS DECIMAL(14,2)) AS balance
        FROM nation LEFT JOIN (SELECT account_id, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS lent FROM grants
                               WHERE code IS NULL GROUP BY account_id) g ON g.account_id = n_nationkey""".format(opening=OPENING_CASH),
    "loan_payments_made": """
        SELECT loan_id, installment_no, due_date AS payment_date, principal_due AS principal_paid, interest_due AS interest_paid
        FROM due JOIN due_steps_done USING (account_id, seq) WHERE accepted""",
    "loan_schedule_marked": """
        SELECT s.loan_id, s.installment_no, p.due_date IS NOT NULL AS paid, p.due_date AS paid_at
        FROM schedule s LEFT JOIN (SELECT loan_id, installment_no, due.due_date FROM due JOIN due_steps_done USING (account_id, seq)
                                   WHERE accepted) p ON p.loan_id = s.loan_id AND p.installment_no = s.installment_no""",
    "loan_schedule": """
        SELECT *, CAST(principal_due + interest_due AS DECIMAL(15,2)) AS total_due FROM schedule""",
    "loan_balance_after_payments": "SELECT loan_id, status, current_principal FROM settled",
    "loan_instalment_outcome": """
        SELECT loan_id, installment_no,
               CASE WHEN principal_due + interest_due <= 0 THEN 50001 WHEN NOT accepted THEN 50005 END AS reason_code
        FROM due LEFT JOIN due_steps_done USING (account_id, seq)""",
    "loans_after_instalments": """
        SELECT loans.loan_id, CASE WHEN principal_amount - coalesce(paid, 0) <= 0 THEN 'closed' ELSE 'active' END AS status,
               CAST(principal_amount - coalesce(paid, 0) AS DECIMAL(14,2)) AS current_principal
        FROM loans LEFT JOIN (SELECT loan_id, sum(principal_due) AS paid FROM due JOIN due_steps_done USING (account_id, seq)
                              WHERE accepted GROUP BY loan_id) p ON p.loan_id = loans.loan_id""",
    "loans_status": f"""
        SELECT l.loan_id, bank_name, start_date, principal_amount, interest_rate, term_months, status, current_principal,
               CAST(count(*) FILTER (due_date <= DATE '{PAID_UNTIL}') AS BIGINT) AS paid_installments,
               count(s.installment_no) AS total_installments,
               min(CASE WHEN due_date > DATE '{PAID_UNTIL}' THEN due_date END) AS next_due_date
        FROM settled l LEFT JOIN schedule s ON s.loan_id = l.loan_id
        GROUP BY l.loan_id, bank_name, start_date, principal_amount, interest_rate, term_months, status, current_principal""",
    "raw_material_balance": """
        SELECT p_partkey AS raw_material_id, p_name AS material_name, p_type AS unit,
               CAST(coalesce(quantity, 0) AS DECIMAL(14,3)) AS quantity, CAST(coalesce(avg_cost, 0) AS DECIMAL(14,2)) AS avg_cost,
               CAST(round(coalesce(CAST(quantity AS DECIMAL(18,3)) * CAST(avg_cost AS DECIMAL(18,2)), 0), 2) AS DECIMAL(38,2)) AS stock_value,
               CAST(p_size * 10 AS DECIMAL(14,3)) AS min_stock,
               CAST(greatest(p_size * 10 - coalesce(quantity, 0), 0) AS DECIMAL(15,3)) AS shortage
        FROM part LEFT JOIN stock ON item = p_partkey""",
    "finished_product_balance": """
        SELECT p_partkey AS product_id, p_brand AS sku, p_name AS product_name, p_type AS category,
               CAST(coalesce(quantity, 0) AS DECIMAL(14,3)) AS quantity, CAST(coalesce(avg_cost, 0) AS DECIMAL(14,2)) AS avg_cost,
               CAST(p_retailprice AS DECIMAL(14,2)) AS sale_price,
               CAST(round(coalesce(CAST(quantity AS DECIMAL(18,3)) * CAST(avg_cost AS DECIMAL(18,2)), 0), 2) AS DECIMAL(38,2)) AS inventory_cost,
               CAST(round(coalesce(CAST(quantity AS DECIMAL(18,3)) * CAST(p_retailprice AS DECIMAL(18,2)), 0), 2) AS DECIMAL(38,2))
                   AS inventory_retail_value
        FROM part LEFT JOIN stock ON item = p_partkey""",
    "company_kpi_monthly": f"""
        SELECT month, revenue, cogs, {_PROFITS}
        FROM (SELECT CAST(date_trunc('month', d) AS DATE) AS month, {_FLOW_SUMS} FROM flows GROUP BY 1)""",
    "period_summary": f"""
        SELECT DATE '{PERIOD[0]}' AS date_from, DATE '{PERIOD[1]}' AS date_to, revenue, cogs, {_PROFITS},
               (SELECT CAST(sum(balance) AS DECIMAL(38,2)) FROM opening) AS current_cash_balance
        FROM (SELECT {_FLOW_SUMS} FROM flows WHERE d BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}')""",
    "json_props": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS is_json FROM events""",
    "dq_check_violations": """
        SELECT 'purchase_order_items.quantity' AS rule, doc_id AS row_key, count(*) AS row_count
        FROM items WHERE quantity <= 0 GROUP BY doc_id
        UNION ALL SELECT 'raw_inventory.cost', c_custkey, 1 FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'purchase_orders.supplier_id_required', o_orderkey, 1 FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "dq_orphan_items": """
        SELECT doc_id AS purchase_id, item AS raw_material_id, quantity, unit_price FROM items
        WHERE item NOT IN (SELECT p_partkey FROM part)""",
    "dq_orphan_references": """
        SELECT 'purchase_orders.supplier_id' AS reference, count(*) AS row_count FROM purchases
        WHERE supplier_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
        UNION ALL SELECT 'sales_orders.customer_id', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'sales_order_items.sales_id', count(*) FROM lines WHERE doc_id NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'bill_of_materials.raw_material_id', count(*) FROM recipe WHERE item NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'employees.position_id', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'positions.department_id', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""",
    "dq_duplicate_keys": """
        SELECT l_orderkey AS purchase_id, l_partkey AS raw_material_id, count(*) AS row_count
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "dq_audit_rules": _audit_rules(),
    "dq_audit_references": _audit_references(),
    "dq_audit_keys": _audit_keys(),
    "dq_duplicate_names": "SELECT p_brand AS sku, count(*) AS row_count FROM part GROUP BY 1 HAVING count(*) > 1",
}

ORACLES: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
