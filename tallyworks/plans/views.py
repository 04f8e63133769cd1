"""The reports as named views over the tables of a snapshot, for ``spark.sql``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tallyworks.plans import reports
from tallyworks.sources.tables import register_views

# View name -> (report, the tables it reads in order).
VIEWS = {
    "v_raw_material_balance": (reports.raw_material_balance, ["raw_materials", "raw_inventory"]),
    "v_finished_product_balance": (reports.finished_product_balance, ["products", "finished_inventory"]),
    "v_production_summary": (reports.production_summary, ["production_orders", "products"]),
    "v_sales_summary": (reports.sales_summary, ["sales_orders", "customers", "sales_order_items"]),
    "v_monthly_payroll": (reports.monthly_payroll, ["payroll"]),
    "v_loans_status": (reports.loans_status, ["loans", "loan_schedule"]),
    "v_company_kpi_monthly": (
        reports.company_kpi_monthly,
        ["sales_orders", "sales_order_items", "purchase_orders", "payroll", "loan_payments"],
    ),
}


def report_views(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every report whose tables are given."""
    return {
        name: report(*[tables[t] for t in needed])
        for name, (report, needed) in VIEWS.items()
        if all(t in tables for t in needed)
    }


def register_books(tables: Mapping[str, DataFrame]) -> list[str]:
    """Register the tables and the reports over them; returns the view names."""
    views = {**tables, **report_views(tables)}
    register_views(views)
    return sorted(views)
