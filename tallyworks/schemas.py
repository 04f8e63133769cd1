"""Declared schemas of the domain tables, as Spark DDL, with their keys and state values.

Computed amounts (line_total, line_cost, total_due, total_paid) are not stored; see
``tallyworks.sources.tables.with_amounts``.
"""

from __future__ import annotations

# Column names and types of the domain tables.
TABLES: dict[str, str] = {
    "suppliers": "supplier_id bigint, supplier_name string, contact_person string, phone string, "
    "email string, created_at timestamp_ntz",
    "raw_materials": "raw_material_id bigint, material_name string, unit string, min_stock decimal(14,3), "
    "created_at timestamp_ntz",
    "supplier_material_prices": "supplier_id bigint, raw_material_id bigint, unit_price decimal(14,2), "
    "effective_from date",
    "raw_inventory": "raw_material_id bigint, quantity decimal(14,3), avg_cost decimal(14,2), "
    "updated_at timestamp_ntz",
    "cash_accounts": "account_id bigint, account_name string, balance decimal(14,2), currency_code string, "
    "created_at timestamp_ntz",
    "cash_movements": "movement_id bigint, movement_date timestamp_ntz, account_id bigint, direction string, "
    "amount decimal(14,2), category string, reference_table string, reference_id bigint, description string",
    "purchase_orders": "purchase_id bigint, supplier_id bigint, order_date date, expected_date date, "
    "received_date date, status string, total_amount decimal(14,2)",
    "purchase_order_items": "purchase_item_id bigint, purchase_id bigint, raw_material_id bigint, "
    "quantity decimal(14,3), unit_price decimal(14,2)",
    "products": "product_id bigint, sku string, product_name string, category string, size_label string, "
    "sale_price decimal(14,2), standard_cost decimal(14,2), created_at timestamp_ntz",
    "bill_of_materials": "product_id bigint, raw_material_id bigint, qty_per_unit decimal(14,3)",
    "production_orders": "production_order_id bigint, product_id bigint, order_date date, "
    "planned_qty decimal(14,3), produced_qty decimal(14,3), completion_date date, status string, "
    "total_cost decimal(14,2)",
    "production_consumption": "consumption_id bigint, production_order_id bigint, raw_material_id bigint, "
    "quantity decimal(14,3), unit_cost decimal(14,2)",
    "finished_inventory": "product_id bigint, quantity decimal(14,3), avg_cost decimal(14,2), "
    "updated_at timestamp_ntz",
    "customers": "customer_id bigint, customer_name string, phone string, email string, created_at timestamp_ntz",
    "sales_orders": "sales_id bigint, customer_id bigint, sales_date date, status string, "
    "total_amount decimal(14,2)",
    "sales_order_items": "sales_item_id bigint, sales_id bigint, product_id bigint, quantity decimal(14,3), "
    "unit_price decimal(14,2), unit_cost decimal(14,2)",
    "departments": "department_id bigint, department_name string",
    "positions": "position_id bigint, department_id bigint, position_name string, base_salary decimal(14,2)",
    "employees": "employee_id bigint, full_name string, hire_date date, position_id bigint, is_active boolean",
    "timesheets": "timesheet_id bigint, employee_id bigint, period_month date, worked_days int, "
    "bonus decimal(14,2), deductions decimal(14,2)",
    "payroll": "payroll_id bigint, employee_id bigint, period_month date, gross_salary decimal(14,2), "
    "tax_amount decimal(14,2), net_salary decimal(14,2), status string, paid_date date",
    "loans": "loan_id bigint, bank_name string, start_date date, principal_amount decimal(14,2), "
    "interest_rate decimal(7,4), term_months int, status string, current_principal decimal(14,2)",
    "loan_schedule": "schedule_id bigint, loan_id bigint, installment_no int, due_date date, "
    "principal_due decimal(14,2), interest_due decimal(14,2), paid boolean, paid_at date",
    "loan_payments": "payment_id bigint, loan_id bigint, schedule_id bigint, payment_date date, "
    "principal_paid decimal(14,2), interest_paid decimal(14,2)",
}

# Computed amount columns, table -> (name, SQL expression).
AMOUNTS: dict[str, tuple[str, str]] = {
    "purchase_order_items": ("line_total", "quantity * unit_price"),
    "production_consumption": ("line_cost", "quantity * unit_cost"),
    "sales_order_items": ("line_total", "quantity * unit_price"),
    "loan_schedule": ("total_due", "principal_due + interest_due"),
    "loan_payments": ("total_paid", "principal_paid + interest_paid"),
}

# Allowed states, (table, column) -> values.
STATES: dict[tuple[str, str], list[str]] = {
    ("cash_movements", "direction"): ["in", "out"],
    ("purchase_orders", "status"): ["draft", "ordered", "received", "cancelled"],
    ("production_orders", "status"): ["planned", "in_progress", "completed", "cancelled"],
    ("sales_orders", "status"): ["draft", "paid", "cancelled"],
    ("payroll", "status"): ["calculated", "paid"],
    ("loans", "status"): ["active", "closed"],
}
