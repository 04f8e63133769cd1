"""Declared constraints as checks over whole tables.

Nothing is enforced on write: each check returns the rows that break a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.schemas import STATES

# Value rules, table -> {rule: condition that must not be false}.
RULES: dict[str, dict[str, str]] = {
    "raw_materials": {"min_stock": "min_stock >= 0"},
    "supplier_material_prices": {"price": "unit_price > 0"},
    "raw_inventory": {"quantity": "quantity >= 0", "cost": "avg_cost >= 0"},
    "cash_movements": {"amount": "amount > 0"},
    "purchase_order_items": {"quantity": "quantity > 0", "price": "unit_price > 0"},
    "products": {"sale_price": "sale_price >= 0", "standard_cost": "standard_cost >= 0"},
    "bill_of_materials": {"quantity": "qty_per_unit > 0"},
    "production_orders": {"quantity": "planned_qty > 0"},
    "production_consumption": {"quantity": "quantity > 0", "cost": "unit_cost >= 0"},
    "finished_inventory": {"quantity": "quantity >= 0", "cost": "avg_cost >= 0"},
    "sales_order_items": {"quantity": "quantity > 0", "price": "unit_price >= 0", "cost": "unit_cost >= 0"},
    "positions": {"salary": "base_salary >= 0"},
    "timesheets": {"days": "worked_days between 0 and 31", "month_start": "day(period_month) = 1"},
    "payroll": {
        "month_start": "day(period_month) = 1",
        "gross": "gross_salary >= 0",
        "tax": "tax_amount >= 0",
        "net": "net_salary >= 0",
    },
    "loans": {
        "principal": "principal_amount > 0",
        "rate": "interest_rate >= 0",
        "term": "term_months > 0",
        "current_principal": "current_principal >= 0",
    },
    "loan_schedule": {
        "installment": "installment_no > 0",
        "principal": "principal_due >= 0",
        "interest": "interest_due >= 0",
    },
    "loan_payments": {"principal": "principal_paid >= 0", "interest": "interest_paid >= 0"},
}

# Columns that may be null; every other column is required.
OPTIONAL: dict[str, list[str]] = {
    "suppliers": ["contact_person", "phone", "email"],
    "cash_movements": ["reference_table", "reference_id", "description"],
    "purchase_orders": ["expected_date", "received_date"],
    "products": ["size_label"],
    "production_orders": ["completion_date"],
    "customers": ["phone", "email"],
    "payroll": ["paid_date"],
    "loan_schedule": ["paid_at"],
}

# Most characters of text columns.
LENGTHS: dict[str, dict[str, int]] = {
    "suppliers": {"supplier_name": 200, "contact_person": 200, "phone": 50, "email": 200},
    "raw_materials": {"material_name": 200, "unit": 30},
    "cash_accounts": {"account_name": 200, "currency_code": 3},
    "cash_movements": {"direction": 3, "category": 100, "reference_table": 128, "description": 400},
    "purchase_orders": {"status": 20},
    "products": {"sku": 50, "product_name": 200, "category": 100, "size_label": 20},
    "production_orders": {"status": 20},
    "customers": {"customer_name": 200, "phone": 50, "email": 200},
    "sales_orders": {"status": 20},
    "departments": {"department_name": 100},
    "positions": {"position_name": 100},
    "employees": {"full_name": 200},
    "payroll": {"status": 20},
    "loans": {"bank_name": 200, "status": 20},
}

# References, (child, column) -> parent; the parent column has the same name.
REFERENCES: dict[tuple[str, str], str] = {
    ("supplier_material_prices", "supplier_id"): "suppliers",
    ("supplier_material_prices", "raw_material_id"): "raw_materials",
    ("raw_inventory", "raw_material_id"): "raw_materials",
    ("cash_movements", "account_id"): "cash_accounts",
    ("purchase_orders", "supplier_id"): "suppliers",
    ("purchase_order_items", "purchase_id"): "purchase_orders",
    ("purchase_order_items", "raw_material_id"): "raw_materials",
    ("bill_of_materials", "product_id"): "products",
    ("bill_of_materials", "raw_material_id"): "raw_materials",
    ("production_orders", "product_id"): "products",
    ("production_consumption", "production_order_id"): "production_orders",
    ("production_consumption", "raw_material_id"): "raw_materials",
    ("finished_inventory", "product_id"): "products",
    ("sales_orders", "customer_id"): "customers",
    ("sales_order_items", "sales_id"): "sales_orders",
    ("sales_order_items", "product_id"): "products",
    ("positions", "department_id"): "departments",
    ("employees", "position_id"): "positions",
    ("timesheets", "employee_id"): "employees",
    ("payroll", "employee_id"): "employees",
    ("loan_schedule", "loan_id"): "loans",
    ("loan_payments", "loan_id"): "loans",
    ("loan_payments", "schedule_id"): "loan_schedule",
}

# Primary keys; the tables that are missing here have one of several columns (see below).
PRIMARY: dict[str, list[str]] = {
    "suppliers": ["supplier_id"],
    "raw_materials": ["raw_material_id"],
    "raw_inventory": ["raw_material_id"],
    "cash_accounts": ["account_id"],
    "cash_movements": ["movement_id"],
    "purchase_orders": ["purchase_id"],
    "purchase_order_items": ["purchase_item_id"],
    "products": ["product_id"],
    "production_orders": ["production_order_id"],
    "production_consumption": ["consumption_id"],
    "finished_inventory": ["product_id"],
    "customers": ["customer_id"],
    "sales_orders": ["sales_id"],
    "sales_order_items": ["sales_item_id"],
    "departments": ["department_id"],
    "positions": ["position_id"],
    "employees": ["employee_id"],
    "timesheets": ["timesheet_id"],
    "payroll": ["payroll_id"],
    "loans": ["loan_id"],
    "loan_schedule": ["schedule_id"],
    "loan_payments": ["payment_id"],
}

# Unique column lists besides single-column surrogate keys.
UNIQUE: dict[str, list[list[str]]] = {
    "raw_materials": [["material_name"]],
    "cash_accounts": [["account_name"]],
    "supplier_material_prices": [["supplier_id", "raw_material_id", "effective_from"]],
    "products": [["sku"]],
    "bill_of_materials": [["product_id", "raw_material_id"]],
    "departments": [["department_name"]],
    "timesheets": [["employee_id", "period_month"]],
    "payroll": [["employee_id", "period_month"]],
    "loan_schedule": [["loan_id", "installment_no"], ["loan_id", "due_date"]],
}


def conditions(table: str, columns: list[str]) -> dict[str, str]:
    """All single-row rules of a table that concern the given columns, name -> condition."""
    out = {f"{table}.{rule}": cond for rule, cond in RULES.get(table, {}).items()}
    for (owner, column), allowed in STATES.items():
        if owner == table and column in columns:
            out[f"{table}.{column}"] = f"{column} in ({', '.join(repr(v) for v in allowed)})"
    for column in columns:
        if column not in OPTIONAL.get(table, []):
            out[f"{table}.{column}_required"] = f"{column} is not null"
        if column in LENGTHS.get(table, {}):
            out[f"{table}.{column}_length"] = f"length({column}) <= {LENGTHS[table][column]}"
    return out


def violations(df: DataFrame, rules: dict[str, str], key: list[str]) -> DataFrame:
    """(rule, key columns) for every row and rule whose condition is false, in one scan.

    A condition that is unknown because of a null passes, as a declared check does.
    """
    broken = F.filter(
        F.array(*[F.when(~F.expr(cond), F.lit(rule)) for rule, cond in rules.items()]), lambda r: r.isNotNull()
    )
    return df.select(F.explode(broken).alias("rule"), *key)


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Child rows whose reference is set and names no parent row."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(column), column, "left_anti")


def existing(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Child rows whose reference names a parent row."""
    return child.join(parent.select(column), column, "left_semi")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")
