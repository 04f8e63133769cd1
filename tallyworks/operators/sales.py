"""Sales: documents to priced lines, stock and cash."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, OVERFLOW, QUANTITY, line_total, money_or_null, total
from tallyworks.operators.acceptance import accept_in_order
from tallyworks.operators.cash import ledger_rows, post_movements
from tallyworks.operators.merge import issue_stock
from tallyworks.operators.outputs import Outputs
from tallyworks.session import materialise
from tallyworks.sources.documents import SALE_ITEM, item_lines, page_lines


def price_lines(lines: DataFrame, products: DataFrame, finished_inventory: DataFrame) -> DataFrame:
    """Lines (doc_id, product_id, quantity, unit_price) with the given or the catalogue price
    and the current average cost. Lines without product or stock row drop out."""
    catalogue = products.select("product_id", "sale_price")
    cost = finished_inventory.select("product_id", F.col("avg_cost").alias("unit_cost"))
    return (
        lines.join(catalogue, "product_id")
        .join(cost, "product_id")
        .select(
            "doc_id",
            "product_id",
            "quantity",
            F.coalesce("unit_price", "sale_price").cast(MONEY).alias("unit_price"),
            "unit_cost",
        )
    )


def need_by_product(lines: DataFrame) -> DataFrame:
    """Quantity of each product that each document needs, over all its lines."""
    return lines.groupBy("doc_id", "product_id").agg(F.sum("quantity").cast(QUANTITY).alias("qty_needed"))


def create_sales(
    documents: DataFrame,
    pages: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    finished_inventory: DataFrame,
    accounts: DataFrame,
    as_of: str,
) -> Outputs:
    """Sell documents (doc_id, customer_id, account_id[, sales_date]) in order of ``doc_id``.

    Returns ``outcome``, ``sales_orders``, ``sales_order_items``, ``finished_inventory``,
    ``cash_accounts`` and ``cash_movements``; what follows the outcome is built when asked for.
    """
    item = F.col("item")
    catalogue = products.select("product_id", F.lit(True).alias("_product"), "sale_price")
    shelf = finished_inventory.select("product_id", F.lit(True).alias("_shelf"), F.col("quantity").alias("stock"))
    bad = item.product_id.isNull() | item.quantity.isNull() | (item.quantity <= 0) | (
        item.unit_price.isNotNull() & (item.unit_price < 0)
    )
    # One row per document and product. Lines are summed first, apart by given and catalogue
    # price, so that products and stock are looked up once per pair.
    pairs = (
        page_lines(pages, SALE_ITEM)
        .groupBy("doc_id", F.col("item.product_id").alias("product_id"))
        .agg(
            F.max("bad_json").alias("bad_json"),
            F.count("item").alias("items"),
            F.max(item.isNotNull() & bad).alias("bad"),
            F.sum(item.quantity).cast("decimal(38,3)").alias("need"),
            F.sum(line_total(item.quantity, item.unit_price)).alias("_given"),
            F.sum(F.when(item.unit_price.isNull(), item.quantity)).cast("decimal(24,3)").alias("_listed"),
        )
    )
    none = F.lit(0).cast("decimal(38,5)")
    by_product = materialise(
        pairs.join(catalogue, "product_id", "left")
        .join(shelf, "product_id", "left")
        .select(
            "doc_id",
            "product_id",
            "bad_json",
            "items",
            "bad",
            ((F.col("items") > 0) & F.col("_product").isNull()).alias("unknown"),
            ((F.col("items") > 0) & F.col("_shelf").isNull()).alias("no_stock"),
            "stock",
            "need",
            (
                F.coalesce("_given", none) + F.coalesce((F.col("_listed") * F.col("sale_price")).cast("decimal(38,5)"), none)
            ).alias("amount"),
        ),
        "sale-needs",
    )
    checks = by_product.groupBy("doc_id").agg(
        F.max("bad_json").alias("bad_json"),
        F.sum("items").alias("items"),
        F.max("bad").alias("bad"),
        F.max("unknown").alias("unknown"),
        F.max("no_stock").alias("no_stock"),
        F.max(F.col("need").isNotNull() & F.col("need").try_cast(QUANTITY).isNull()).alias("wide"),
        money_or_null(total(F.sum("amount"))).alias("total_amount"),
        # More than the opening stock: refused whatever earlier documents take.
        F.coalesce(F.max(F.col("need") > F.col("stock")), F.lit(False)).alias("_short"),
    )
    buyer = customers.select("customer_id", F.lit(True).alias("_customer"))
    account = accounts.select("account_id", F.lit(True).alias("_account"))
    code = (
        F.when(F.col("_customer").isNull(), 53001)
        .when(F.col("bad_json"), 53002)
        .when(F.coalesce("items", F.lit(0)) == 0, 53003)
        .when(F.col("bad"), 53004)
        .when(F.col("unknown"), 53005)
        .when(F.col("no_stock"), 53006)
        .when(F.col("wide") | F.col("total_amount").isNull(), OVERFLOW)
    )
    late_code = F.when(F.col("total_amount") <= 0, 50001).when(F.col("_account").isNull(), 50003)
    checked = materialise(
        documents.join(buyer, "customer_id", "left")
        .join(account, "account_id", "left")
        .join(checks, "doc_id", "left")
        .select(*documents.columns, "total_amount", code.alias("_code"), late_code.alias("_late"), "_short"),
        "sale-checks",
    )
    candidates = checked.filter("_code is null and not _short").select("doc_id", F.col("_late").isNull().alias("takes"))
    # An empty page is a row without product.
    named = by_product.filter(F.col("product_id").isNotNull())
    accepted = accept_in_order(
        named.join(candidates, "doc_id").select(
            F.col("doc_id").alias("seq"),
            F.col("product_id").alias("key"),
            F.col("need").try_cast(QUANTITY).alias("need"),
            "stock",
            "takes",
        )
    ).withColumnRenamed("seq", "doc_id")
    reason = (
        F.when(F.col("_code").isNotNull(), F.col("_code")).when(F.col("_short") | ~F.col("accepted"), 53007).otherwise(F.col("_late"))
    )
    outcome = materialise(
        checked.join(accepted, "doc_id", "left").select(
            *documents.columns, reason.alias("reason_code"), "total_amount"
        ),
        "sale-outcome",
    )
    sold = outcome.filter(F.col("reason_code").isNull())
    today = F.lit(as_of).cast("date")
    sales_date = F.coalesce("sales_date", today) if "sales_date" in documents.columns else today
    orders = sold.select(
        F.col("doc_id").alias("sales_id"),
        "customer_id",
        sales_date.alias("sales_date"),
        F.lit("paid").alias("status"),
        "total_amount",
    )
    sold_lines = item_lines(pages.join(sold.select("doc_id"), "doc_id", "left_semi"), SALE_ITEM)
    items = price_lines(sold_lines, products, finished_inventory).withColumnRenamed("doc_id", "sales_id")
    issued = named.join(sold.select("doc_id"), "doc_id", "left_semi").select(
        "product_id", F.col("need").alias("qty")
    )

    @cache
    def cash() -> dict[str, DataFrame]:
        return post_movements(
            sold.select(
                F.col("doc_id").alias("seq"),
                "account_id",
                F.lit("in").alias("direction"),
                F.col("total_amount").alias("amount"),
                F.lit("sale").alias("category"),
                F.lit("sales_orders").alias("reference_table"),
                F.col("doc_id").alias("reference_id"),
                F.lit("sale of products").alias("description"),
            ),
            accounts,
        )

    return Outputs(
        {
            "outcome": lambda: outcome.select(*documents.columns, "reason_code"),
            "sales_orders": lambda: orders,
            "sales_order_items": lambda: items,
            "finished_inventory": lambda: issue_stock(finished_inventory, issued, "product_id"),
            "cash_accounts": lambda: cash()["accounts"],
            "cash_movements": lambda: ledger_rows(cash()["accepted"]),
        }
    )
