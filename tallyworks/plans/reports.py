"""Management reports over the domain tables.

Lines are summed per document before they meet their header, so a long document costs one
row in the join and headers join one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import (
    MONEY,
    QUANTITY,
    TOTAL,
    line_total,
    month_start,
    per_unit,
    total,
    total_or_zero,
    zero_if_null,
)


def raw_material_balance(raw_materials: DataFrame, raw_inventory: DataFrame) -> DataFrame:
    """Stock, value and shortage of every material."""
    stock = raw_inventory.select("raw_material_id", "quantity", "avg_cost")
    missing = F.col("min_stock") - F.col("quantity")
    return (
        raw_materials.select("raw_material_id", "material_name", "unit", "min_stock")
        .join(stock, "raw_material_id", "left")
        .withColumn("quantity", zero_if_null(F.col("quantity"), QUANTITY))
        .withColumn("avg_cost", zero_if_null(F.col("avg_cost"), MONEY))
        .select(
            "raw_material_id",
            "material_name",
            "unit",
            "quantity",
            "avg_cost",
            total(line_total(F.col("quantity"), F.col("avg_cost"))).alias("stock_value"),
            "min_stock",
            F.greatest(missing, F.lit(0)).cast("decimal(15,3)").alias("shortage"),
        )
    )


def finished_product_balance(products: DataFrame, finished_inventory: DataFrame) -> DataFrame:
    """Stock of every product at cost and at catalogue price."""
    stock = finished_inventory.select("product_id", "quantity", "avg_cost")
    return (
        products.select("product_id", "sku", "product_name", "category", "sale_price")
        .join(stock, "product_id", "left")
        .withColumn("quantity", zero_if_null(F.col("quantity"), QUANTITY))
        .withColumn("avg_cost", zero_if_null(F.col("avg_cost"), MONEY))
        .select(
            "product_id",
            "sku",
            "product_name",
            "category",
            "quantity",
            "avg_cost",
            "sale_price",
            total(line_total(F.col("quantity"), F.col("avg_cost"))).alias("inventory_cost"),
            total(line_total(F.col("quantity"), F.col("sale_price"))).alias("inventory_retail_value"),
        )
    )


def production_summary(production_orders: DataFrame, products: DataFrame) -> DataFrame:
    """Production orders with product name and cost per unit."""
    return production_orders.join(products.select("product_id", "product_name"), "product_id").select(
        "production_order_id",
        "order_date",
        "completion_date",
        "status",
        "product_name",
        "produced_qty",
        "total_cost",
        per_unit(F.col("total_cost"), F.col("produced_qty")).alias("unit_cost"),
    )


def _sale_lines(items: DataFrame) -> DataFrame:
    return items.select(
        "sales_id",
        line_total(F.col("quantity"), F.col("unit_price")).alias("revenue"),
        line_total(F.col("quantity"), F.col("unit_cost")).alias("cogs"),
    )


def _sale_sums(items: DataFrame) -> DataFrame:
    return _sale_lines(items).groupBy("sales_id").agg(F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs"))


def sales_summary(sales_orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """Revenue, cost and gross profit of every sale, whatever its state; sales without lines are 0."""
    return (
        sales_orders.join(customers.select("customer_id", "customer_name"), "customer_id")
        .join(_sale_sums(items), "sales_id", "left")
        .select(
            "sales_id",
            "sales_date",
            "customer_name",
            "status",
            total_or_zero(F.col("revenue")).alias("revenue"),
            total_or_zero(F.col("cogs")).alias("cogs"),
            total_or_zero(F.col("revenue") - F.col("cogs")).alias("gross_profit"),
        )
    )


def monthly_payroll(payroll: DataFrame) -> DataFrame:
    """Employees and pay per month, whatever the state."""
    return payroll.groupBy("period_month").agg(
        F.count(F.lit(1)).alias("employees_count"),
        total(F.sum("gross_salary")).alias("total_gross_salary"),
        total(F.sum("tax_amount")).alias("total_tax"),
        total(F.sum("net_salary")).alias("total_net_salary"),
    )


def loans_status(loans: DataFrame, schedule: DataFrame) -> DataFrame:
    """Loans with paid and total instalments and the next due date."""
    progress = schedule.groupBy("loan_id").agg(
        F.sum(F.when(F.col("paid"), 1).otherwise(0)).alias("paid_installments"),
        F.count("installment_no").alias("total_installments"),
        F.min(F.when(~F.col("paid"), F.col("due_date"))).alias("next_due_date"),
    )
    none = F.lit(0).cast("bigint")
    return loans.join(progress, "loan_id", "left").select(
        "loan_id",
        "bank_name",
        "start_date",
        "principal_amount",
        "interest_rate",
        "term_months",
        "status",
        "current_principal",
        F.coalesce("paid_installments", none).alias("paid_installments"),
        F.coalesce("total_installments", none).alias("total_installments"),
        "next_due_date",
    )


# Amount columns of the monthly and period reports.
FLOWS = ("revenue", "cogs", "purchase_expense", "payroll_expense", "loan_interest_expense")


def _flows(
    sales_orders: DataFrame,
    items: DataFrame,
    purchase_orders: DataFrame,
    payroll: DataFrame,
    loan_payments: DataFrame,
    between: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Dated amounts that count for profit: paid sales, received purchases, paid payroll, interest."""

    def dated(df: DataFrame, date: str) -> DataFrame:
        kept = df.filter(F.col(date).isNotNull())
        if between:
            kept = kept.filter(F.col(date).between(*[F.lit(d).cast("date") for d in between]))
        return kept.withColumnRenamed(date, "on_date")

    sold = dated(sales_orders.filter("status = 'paid'").select("sales_id", "sales_date"), "sales_date")
    # Lines are summed per sale before the exchange, so a long sale is one row a task. On large tables Spark
    # filters the scan of lines by the kept sales at run time (a Bloom filter below the sums).
    return {
        "sales": sold.join(_sale_sums(items), "sales_id").select("on_date", "revenue", "cogs"),
        "purchases": dated(purchase_orders.filter("status = 'received'"), "received_date").select(
            "on_date", F.col("total_amount").alias("purchase_expense")
        ),
        "payroll": dated(payroll.filter("status = 'paid'"), "paid_date").select(
            "on_date", F.col("net_salary").alias("payroll_expense")
        ),
        "interest": dated(loan_payments, "payment_date").select(
            "on_date", F.col("interest_paid").alias("loan_interest_expense")
        ),
    }


def _profit(*costs: str) -> Column:
    out = F.col("revenue")
    for c in costs:
        out = out - F.col(c)
    return total(out)


def company_kpi_monthly(
    sales_orders: DataFrame,
    items: DataFrame,
    purchase_orders: DataFrame,
    payroll: DataFrame,
    loan_payments: DataFrame,
) -> DataFrame:
    """Monthly revenue, costs and profit. Purchases are shown but do not lower the profit."""
    flows = _flows(sales_orders, items, purchase_orders, payroll, loan_payments)
    monthly = [
        df.groupBy(month_start(F.col("on_date")).alias("month")).agg(
            *[total(F.sum(c)).alias(c) for c in df.columns if c != "on_date"]
        )
        for df in flows.values()
    ]
    # Each source gives at most one row per month, so stacking and regrouping them joins them on
    # the union of their months, and every source is computed once.
    stacked = monthly[0]
    for m in monthly[1:]:
        stacked = stacked.unionByName(m, allowMissingColumns=True)
    out = stacked.groupBy("month").agg(*[F.max(c).alias(c) for c in FLOWS])
    return out.withColumns({c: zero_if_null(F.col(c), TOTAL) for c in FLOWS}).select(
        "month",
        "revenue",
        "cogs",
        _profit("cogs").alias("gross_profit"),
        "purchase_expense",
        "payroll_expense",
        "loan_interest_expense",
        _profit("cogs", "payroll_expense", "loan_interest_expense").alias("operating_profit"),
    )


def period_summary(
    date_from: str,
    date_to: str,
    sales_orders: DataFrame,
    items: DataFrame,
    purchase_orders: DataFrame,
    payroll: DataFrame,
    loan_payments: DataFrame,
    cash_accounts: DataFrame,
) -> DataFrame:
    """One row for an inclusive date range; the cash balance is the current one."""
    flows = _flows(sales_orders, items, purchase_orders, payroll, loan_payments, (date_from, date_to))
    # Each source gives one row of its own sums; the rows are stacked and summed once more.
    parts = [df.agg(*[F.sum(c).alias(c) for c in df.columns if c != "on_date"]) for df in flows.values()]
    parts.append(cash_accounts.agg(F.sum("balance").alias("current_cash_balance")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    sums = stacked.agg(*[total_or_zero(F.sum(c)).alias(c) for c in (*FLOWS, "current_cash_balance")])
    return sums.select(
        F.lit(date_from).cast("date").alias("date_from"),
        F.lit(date_to).cast("date").alias("date_to"),
        "revenue",
        "cogs",
        _profit("cogs").alias("gross_profit"),
        "purchase_expense",
        "payroll_expense",
        "loan_interest_expense",
        _profit("cogs", "payroll_expense", "loan_interest_expense").alias("operating_profit"),
        "current_cash_balance",
    )
