"""Purchases: documents to orders, and orders to stock and cash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import OVERFLOW, line_total, money_or_null, total
from tallyworks.operators.cash import ledger_rows, post_movements
from tallyworks.operators.merge import merge_receipts
from tallyworks.operators.outputs import Outputs
from tallyworks.operators.requests import first_requests, repeated_requests
from tallyworks.session import materialise
from tallyworks.sources.documents import PURCHASE_ITEM, item_lines, page_lines


def create_purchase_orders(
    documents: DataFrame, pages: DataFrame, suppliers: DataFrame, raw_materials: DataFrame, as_of: str | None = None
) -> dict[str, DataFrame]:
    """Validate documents (doc_id, supplier_id[, order_date, expected_date]) and their JSON pages.

    Returns ``outcome`` (all documents with reason_code and total_amount), the new
    ``purchase_orders`` in state ordered and their ``purchase_order_items``.
    """
    item = F.col("item")
    known = raw_materials.select(F.col("raw_material_id").alias("_material"))
    lines = page_lines(pages, PURCHASE_ITEM).join(known, F.col("item.raw_material_id") == F.col("_material"), "left")
    bad = (
        item.raw_material_id.isNull()
        | item.quantity.isNull()
        | item.unit_price.isNull()
        | (item.quantity <= 0)
        | (item.unit_price <= 0)
    )
    checks = lines.groupBy("doc_id").agg(
        F.max("bad_json").alias("_bad_json"),
        F.count("item").alias("_items"),
        F.max(item.isNotNull() & bad).alias("_bad"),
        F.max(item.isNotNull() & F.col("_material").isNull()).alias("_unknown"),
        total(F.sum(line_total(item.quantity, item.unit_price))).alias("_total"),
    )
    supplier = suppliers.select("supplier_id", F.lit(True).alias("_supplier"))
    code = (
        F.when(F.col("_supplier").isNull(), 51001)
        .when(F.col("_bad_json"), 51002)
        .when(F.coalesce("_items", F.lit(0)) == 0, 51003)
        .when(F.col("_bad"), 51004)
        .when(F.col("_unknown"), 51005)
        .when(money_or_null(F.col("_total")).isNull(), OVERFLOW)
    )
    # Orders and lines both depend on the outcome, so it is computed once.
    outcome = materialise(
        documents.join(supplier, "supplier_id", "left")
        .join(checks, "doc_id", "left")
        .withColumn("reason_code", code)
        .select(
            *documents.columns,
            "reason_code",
            F.when(F.col("reason_code").isNull(), money_or_null(F.col("_total"))).alias("total_amount"),
        ),
        "purchase-outcome",
    )
    accepted = outcome.filter(F.col("reason_code").isNull())
    today = F.lit(as_of).cast("date")
    order_date = F.coalesce("order_date", today) if "order_date" in documents.columns else today
    expected = F.col("expected_date") if "expected_date" in documents.columns else F.lit(None).cast("date")
    orders = accepted.select(
        F.col("doc_id").alias("purchase_id"),
        "supplier_id",
        order_date.alias("order_date"),
        expected.alias("expected_date"),
        F.lit(None).cast("date").alias("received_date"),
        F.lit("ordered").alias("status"),
        "total_amount",
    )
    items = (
        item_lines(pages, PURCHASE_ITEM)
        .join(accepted.select("doc_id"), "doc_id", "left_semi")
        .withColumnRenamed("doc_id", "purchase_id")
    )
    return {"outcome": outcome, "purchase_orders": orders, "purchase_order_items": items}


def receipt_by_material(items: DataFrame) -> DataFrame:
    """Quantity and cost of each material in each purchase."""
    return items.groupBy("purchase_id", "raw_material_id").agg(
        F.sum("quantity").alias("qty"), F.sum(line_total(F.col("quantity"), F.col("unit_price"))).alias("total_cost")
    )


def receive_purchase_orders(
    requests: DataFrame,
    purchase_orders: DataFrame,
    items: DataFrame,
    raw_inventory: DataFrame,
    accounts: DataFrame,
    as_of: str,
) -> Outputs:
    """Receive purchases (seq, purchase_id, account_id) in order: cash is decided first, then stock.

    Of several requests for one purchase the first is tried. Once it is accepted the others are
    refused as received (51007); if it is refused for its own sake they get the same code. Only after a
    refusal for want of cash or an account do they come back as ``deferred``, to be tried in the next
    batch. A request without a purchase gets 51006.
    """
    marked, counted = first_requests(requests, ["purchase_id"])
    orders = purchase_orders.select("purchase_id", "status", "total_amount")
    code = F.when(F.col("status").isNull(), 51006).when(F.col("status") != "ordered", 51007)
    checked = materialise(
        counted.join(orders, "purchase_id", "left").withColumn("_code", code), "purchase-requests"
    )
    movements = checked.filter(F.col("_code").isNull()).select(
        "seq",
        "account_id",
        F.lit("out").alias("direction"),
        F.col("total_amount").alias("amount"),
        F.lit("purchase").alias("category"),
        F.lit("purchase_orders").alias("reference_table"),
        F.col("purchase_id").alias("reference_id"),
        F.lit("raw material purchase").alias("description"),
    )
    cash = post_movements(movements, accounts)
    outcome = checked.select("seq", "purchase_id", F.col("_code").alias("reason_code")).filter(
        F.col("reason_code").isNotNull()
    ).unionByName(cash["outcome"].select("seq", F.col("reference_id").alias("purchase_id"), "reason_code"))
    repeated, deferred = repeated_requests(marked, outcome, ["purchase_id"], 51007)
    outcome = outcome.unionByName(repeated)
    paid = cash["accepted"].select("seq", F.col("reference_id").alias("purchase_id"))

    def stock() -> DataFrame:
        # Lines are summed before the join, so a long purchase is one row per material.
        receipts = materialise(receipt_by_material(items).join(paid, "purchase_id"), "material-receipts")
        return merge_receipts(raw_inventory, receipts, "raw_material_id")["inventory"]

    received = paid.select("purchase_id", F.lit(True).alias("_received"))
    today = F.lit(as_of).cast("date")
    updated = (
        purchase_orders.join(received, "purchase_id", "left")
        .withColumn("status", F.when(F.col("_received"), "received").otherwise(F.col("status")))
        .withColumn("received_date", F.when(F.col("_received"), today).otherwise(F.col("received_date")))
        .select(*purchase_orders.columns)
    )
    return Outputs(
        {
            "outcome": lambda: outcome,
            "deferred": lambda: deferred,
            "purchase_orders": lambda: updated,
            "raw_inventory": stock,
            "cash_accounts": lambda: cash["accounts"],
            "cash_movements": lambda: ledger_rows(cash["accepted"]),
        }
    )
