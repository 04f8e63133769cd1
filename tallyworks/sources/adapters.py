"""Domain tables as projections of the star-schema test tables.

Money in the test tables is double: it is cast to decimal before any arithmetic. Every
mapping is a narrow projection unless its docstring says otherwise.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.money import cents, money, month_start, quantity, total
from tallyworks.sources.documents import PURCHASE_ITEM, item_lines

# Schemas of the star-schema tables that the mappings read.
STAR: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

OPENING_CASH = 1_000_000
PAYROLL_MONTHS = ("2024-01-01", "2024-02-01")
PAID_UNTIL = "2000-12-31"


class StarBooks:
    """The domain tables of one star-schema folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def star(self, name: str) -> DataFrame:
        return self.spark.read.schema(STAR[name]).parquet(os.path.join(self.folder, f"{name}.parquet"))

    # procurement -----------------------------------------------------------------

    def suppliers(self) -> DataFrame:
        """Suppliers in good standing; documents naming another supplier are unknown."""
        return self.star("supplier").filter("s_acctbal >= 0").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name")
        )

    def raw_materials(self) -> DataFrame:
        return self.star("part").select(
            F.col("p_partkey").alias("raw_material_id"),
            F.col("p_name").alias("material_name"),
            F.col("p_type").alias("unit"),
            quantity(F.col("p_size") * 10).alias("min_stock"),
        )

    def raw_inventory(self) -> DataFrame:
        """Stock rows; sizes divisible by 7 have none."""
        return self._stock("raw_material_id")

    def finished_inventory(self) -> DataFrame:
        return self._stock("product_id")

    def _stock(self, key: str) -> DataFrame:
        price = money(F.col("p_retailprice"))
        return self.star("part").filter("p_size % 7 <> 0").select(
            F.col("p_partkey").alias(key),
            quantity((F.col("p_partkey") % 13) * 25).alias("quantity"),
            money(F.round(price * F.lit(0.5).cast("decimal(2,1)"), 2)).alias("avg_cost"),
        )

    def purchase_order_items(self) -> DataFrame:
        """Lines of all purchases. Supplier and ship date ride along for the header."""
        return self.star("lineitem").select(
            F.col("l_orderkey").alias("purchase_id"),
            F.col("l_partkey").alias("raw_material_id"),
            quantity(F.col("l_quantity")).alias("quantity"),
            unit_price().alias("unit_price"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").cast("date").alias("ship_date"),
        )

    def stock_events(self) -> DataFrame:
        """Receipts and issues of materials in order of the purchases: what a purchase sends back is issued
        behind its receipts."""
        back = F.col("l_returnflag") == "R"
        amount = quantity(F.col("l_quantity")) * unit_price()
        return (
            self.star("lineitem")
            .groupBy(
                (2 * F.col("l_orderkey") + back.cast("bigint")).alias("seq"),
                F.col("l_partkey").alias("raw_material_id"),
                F.when(back, "issue").otherwise("receipt").alias("kind"),
            )
            .agg(
                quantity(F.sum(quantity(F.col("l_quantity")))).alias("qty"),
                F.when(F.col("kind") == "receipt", F.sum(amount).cast("decimal(38,5)")).alias("total_cost"),
            )
        )

    def purchase_orders(self) -> DataFrame:
        """Headers with the line totals: lines are summed per purchase, then joined one to one."""
        lines = (
            self.purchase_order_items()
            .groupBy("purchase_id")
            .agg(
                money(total(F.sum(F.col("quantity") * F.col("unit_price")))).alias("total_amount"),
                F.min("supplier_id").alias("supplier_id"),
                F.max("ship_date").alias("last_ship_date"),
            )
        )
        status = (
            F.when(F.col("o_orderstatus") == "F", "received")
            .when(F.col("o_orderstatus") == "O", "ordered")
            .otherwise("cancelled")
        )
        orders = self.star("orders").select(
            F.col("o_orderkey").alias("purchase_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            status.alias("status"),
        )
        # Two numbers of an order are a few bytes of its file, so millions of orders would look small enough to broadcast.
        return orders.join(lines.hint("merge"), "purchase_id").select(
            "purchase_id",
            "supplier_id",
            "order_date",
            "status",
            F.when(F.col("status") == "received", F.col("last_ship_date")).alias("received_date"),
            "total_amount",
        )

    # production ------------------------------------------------------------------

    def products(self) -> DataFrame:
        return self.star("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            money(F.col("p_retailprice")).alias("sale_price"),
            money(F.lit(0)).alias("standard_cost"),
        )

    def bill_of_materials(self) -> DataFrame:
        """Three materials per product, all in its block of four part keys. Parts of size 50 have no recipe."""
        recipe = F.array(
            *[
                F.struct(
                    F.col("p_partkey").bitwiseXOR(F.lit(k).cast("bigint")).alias("raw_material_id"),
                    F.lit(q).cast("decimal(14,3)").alias("qty_per_unit"),
                )
                for k, q in ((0, "0.250"), (1, "0.500"), (2, "0.375"))
            ]
        )
        return self.star("part").filter("p_size < 50").select(F.col("p_partkey").alias("product_id"), F.inline(recipe))

    def production_requests(self) -> DataFrame:
        """One run per order; the customer key stands for the product."""
        return self.star("orders").select(
            F.col("o_orderkey").alias("production_order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_custkey").alias("product_id"),
            quantity(F.expr("1 + cast(o_totalprice as bigint) % 50")).alias("quantity"),
        )

    # sales -----------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self.star("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
        )

    def sales_orders(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "draft").otherwise("cancelled")
        )
        return self.star("orders").select(
            F.col("o_orderkey").alias("sales_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("sales_date"),
            status.alias("status"),
        )

    def sales_order_items(self) -> DataFrame:
        cost = money(F.round(unit_price() * F.lit(0.6).cast("decimal(2,1)"), 2))
        return self.star("lineitem").select(
            F.col("l_orderkey").alias("sales_id"),
            F.col("l_partkey").alias("product_id"),
            quantity(F.col("l_quantity")).alias("quantity"),
            unit_price().alias("unit_price"),
            cost.alias("unit_cost"),
        )

    # staff -----------------------------------------------------------------------

    def departments(self) -> DataFrame:
        return self.star("region").select(
            F.col("r_regionkey").alias("department_id"), F.col("r_name").alias("department_name")
        )

    def positions(self) -> DataFrame:
        return self.star("nation").select(
            F.col("n_nationkey").alias("position_id"),
            F.col("n_regionkey").alias("department_id"),
            F.col("n_name").alias("position_name"),
            money(200000 + 10000 * F.col("n_nationkey")).alias("base_salary"),
        )

    def employees(self) -> DataFrame:
        return self.star("customer").select(
            F.col("c_custkey").alias("employee_id"),
            F.col("c_name").alias("full_name"),
            F.col("c_nationkey").alias("position_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    def timesheets(self) -> DataFrame:
        """Events per user and month. Days are de-duplicated first, so a busy user is reduced
        to at most 31 rows a month before the second shuffle."""
        value = money(F.col("value"))
        days = (
            self.star("events")
            .select(
                F.col("user_id").alias("employee_id"),
                F.col("ts").cast("date").alias("day"),
                F.when(F.col("event_type") == "purchase", value).alias("bonus"),
                F.when(F.col("event_type") == "error", value).alias("deduction"),
            )
            .groupBy("employee_id", "day")
            .agg(F.sum("bonus").alias("bonus"), F.sum("deduction").alias("deduction"))
        )
        return days.groupBy("employee_id", month_start(F.col("day")).alias("period_month")).agg(
            F.count(F.lit(1)).cast("int").alias("worked_days"),
            money(F.coalesce(F.sum("bonus"), F.lit(0))).alias("bonus"),
            money(F.coalesce(F.sum("deduction"), F.lit(0))).alias("deductions"),
        )

    def segments(self) -> DataFrame:
        """Employees whose pay is released: all but one market segment."""
        return self.star("customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(
            F.col("c_custkey").alias("employee_id")
        )

    # credit ----------------------------------------------------------------------

    def loan_requests(self) -> DataFrame:
        """Urgent orders are financed by a loan."""
        return self.star("orders").filter("o_orderpriority = '1-URGENT'").select(
            F.col("o_orderkey").alias("loan_id"),
            F.col("o_orderpriority").alias("bank_name"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            money(F.col("o_totalprice")).alias("principal_amount"),
            F.expr("o_custkey % 25").cast("decimal(7,4)").alias("interest_rate"),
            F.expr("cast(6 + o_custkey % 19 as int)").alias("term_months"),
        )

    # cash ------------------------------------------------------------------------

    def user_accounts(self) -> DataFrame:
        """One account per customer, opened with the customer's balance (never below zero)."""
        return self.star("customer").select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            money(F.greatest(money(F.col("c_acctbal")), F.lit(0))).alias("balance"),
            F.lit("KZT").alias("currency_code"),
        )

    def nation_accounts(self, opening: int = OPENING_CASH) -> DataFrame:
        """One account per nation, for document batches."""
        return self.star("nation").select(
            F.col("n_nationkey").cast("bigint").alias("account_id"),
            F.col("n_name").alias("account_name"),
            money(F.lit(opening)).alias("balance"),
            F.lit("KZT").alias("currency_code"),
        )

    def event_movements(self) -> DataFrame:
        """Events as cash movements; ``event_id`` ascends with time."""
        direction = F.when(F.col("event_type").isin("purchase", "signup"), "in").otherwise("out")
        return self.star("events").select(
            F.col("event_id").alias("seq"),
            F.col("ts").alias("movement_date"),
            F.col("user_id").alias("account_id"),
            direction.alias("direction"),
            money(F.col("value")).alias("amount"),
            F.col("event_type").alias("category"),
        )

    # all tables --------------------------------------------------------------------

    def arriving(self) -> dict[str, DataFrame]:
        """The mapped tables as they arrive, unchecked: purchase lines come from their JSON documents, runs are
        requests, and events are movements of any amount."""
        moves = self.event_movements().withColumnRenamed("seq", "movement_id")
        lines = item_lines(self.purchase_pages(), PURCHASE_ITEM).withColumnRenamed("doc_id", "purchase_id")
        runs = self.production_requests().withColumnRenamed("quantity", "planned_qty")
        return {
            "suppliers": self.suppliers(),
            "raw_materials": self.raw_materials(),
            "raw_inventory": self.raw_inventory(),
            "cash_accounts": self.user_accounts(),
            "cash_movements": moves,
            "purchase_orders": self.purchase_orders(),
            "purchase_order_items": lines,
            "products": self.products(),
            "bill_of_materials": self.bill_of_materials(),
            "production_orders": runs.withColumn("status", F.lit("planned")),
            "finished_inventory": self.finished_inventory(),
            "customers": self.customers(),
            "sales_orders": self.sales_orders(),
            "sales_order_items": self.sales_order_items(),
            "departments": self.departments(),
            "positions": self.positions(),
            "employees": self.employees(),
            "timesheets": self.timesheets(),
            "loans": self.loan_requests()
            .withColumn("status", F.lit("active"))
            .withColumn("current_principal", F.col("principal_amount")),
        }

    # JSON documents ----------------------------------------------------------------

    def purchase_documents(self) -> DataFrame:
        """Headers of purchase documents; a purchase without lines names no supplier."""
        supplier = self.purchase_order_items().groupBy("purchase_id").agg(F.min("supplier_id").alias("supplier_id"))
        return (
            self.star("orders")
            .select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("order_date"))
            .join(supplier.withColumnRenamed("purchase_id", "doc_id"), "doc_id", "left")
        )

    def sale_documents(self) -> DataFrame:
        """Headers of sale documents, paid into the account of the customer's nation."""
        nation = self.star("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("account_id")
        )
        orders = self.star("orders").select(
            F.col("o_orderkey").alias("doc_id"), "o_custkey", F.col("o_orderdate").cast("date").alias("sales_date")
        )
        return orders.join(nation, "o_custkey").withColumnRenamed("o_custkey", "customer_id")

    def purchase_pages(self) -> DataFrame:
        return self._pages("raw_material_id", F.col("unit_price"))

    def sale_pages(self) -> DataFrame:
        """Undiscounted lines carry no price: the catalogue price applies."""
        return self._pages("product_id", F.when(F.col("l_discount") != 0, F.col("unit_price")))

    def _pages(self, key: str, price: Column) -> DataFrame:
        """JSON items, one page per line, so that a long document is never built in one cell.

        Untaxed lines carry planted defects, told apart by their discount: 1% a truncated
        page, 2% zero quantity, 3% an unknown key, 4% an empty list. A line with the highest
        tax and no discount is a single object instead of a list.
        """
        defect = F.when(F.col("l_tax") == 0, F.round(F.col("l_discount") * 100).cast("int"))
        lines = self.star("lineitem").select(
            F.col("l_orderkey").alias("doc_id"),
            "l_discount",
            "l_tax",
            defect.alias("defect"),
            unit_price().alias("unit_price"),
            F.when(defect == 3, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("item_key"),
            quantity(F.when(defect == 2, F.lit(0)).otherwise(F.col("l_quantity"))).alias("item_quantity"),
        )
        text = F.to_json(
            F.struct(
                F.col("item_key").alias(key), F.col("item_quantity").alias("quantity"), price.alias("unit_price")
            )
        )
        page = (
            F.when(F.col("defect") == 1, F.concat(F.lit("["), text))
            .when(F.col("defect") == 4, F.lit("[]"))
            .when((F.col("l_tax") > 0.075) & (F.col("l_discount") == 0), text)
            .otherwise(F.concat(F.lit("["), text, F.lit("]")))
        )
        return lines.select("doc_id", page.alias("items_json"))


def unit_price() -> Column:
    """Extended price per unit of a line, rounded half up to cents, in whole-number arithmetic."""
    ext = (money(F.col("l_extendedprice")) * 100).cast("bigint")
    units = F.col("l_quantity").cast("bigint")
    return cents(F.call_function("div", 2 * ext + units, F.when(units != 0, 2 * units)))
