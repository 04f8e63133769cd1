"""Production runs: recipes to material needs, stock and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, OVERFLOW, QUANTITY, line_total, money_or_null, per_unit, total, zero_if_null
from tallyworks.operators.acceptance import accept_in_order
from tallyworks.operators.merge import issue_stock, merge_receipts
from tallyworks.operators.outputs import Outputs
from tallyworks.session import materialise


def explode_recipe(requests: DataFrame, bill_of_materials: DataFrame, raw_inventory: DataFrame) -> DataFrame:
    """Material needs of runs (production_order_id, product_id, quantity): required_qty,
    unit_cost (the current average, 0 without a stock row) and stock_qty. A need beyond its column is null.

    Recipes and stock are merged, never broadcast: their rows grow with the products, and Spark sizes them by files
    that hold a few bytes for a row.
    """
    stock = raw_inventory.select(
        "raw_material_id", F.col("quantity").alias("stock_qty"), F.col("avg_cost").alias("_avg")
    )
    return (
        requests.select("production_order_id", "product_id", "quantity")
        .join(bill_of_materials.hint("merge"), "product_id")
        .join(stock.hint("merge"), "raw_material_id", "left")
        .select(
            "production_order_id",
            "product_id",
            "raw_material_id",
            F.round(F.col("qty_per_unit") * F.col("quantity"), 3).try_cast(QUANTITY).alias("required_qty"),
            zero_if_null(F.col("_avg"), MONEY).alias("unit_cost"),
            "stock_qty",
        )
    )


def shortages(needs: DataFrame) -> DataFrame:
    """Needs that one run alone cannot meet from the stock."""
    return needs.filter(F.col("stock_qty") < F.col("required_qty")).withColumn(
        "missing_qty", (F.col("required_qty") - F.col("stock_qty")).cast(QUANTITY)
    )


def run_cost(needs: DataFrame) -> DataFrame:
    """Total cost per run."""
    return needs.groupBy("production_order_id").agg(
        money_or_null(total(F.sum(line_total(F.col("required_qty"), F.col("unit_cost"))))).alias("total_cost")
    )


def run_production(
    requests: DataFrame,
    products: DataFrame,
    bill_of_materials: DataFrame,
    raw_inventory: DataFrame,
    finished_inventory: DataFrame,
    as_of: str,
) -> Outputs:
    """Run production (production_order_id, product_id, quantity, order_date) in order of its key.

    Returns ``outcome``, ``production_orders``, ``production_consumption``, both inventories
    and ``products`` with the unit cost of their last run; what follows the outcome is built when asked for.
    """
    known = products.select("product_id", F.lit(True).alias("_product"))
    needs = materialise(
        explode_recipe(requests.filter("quantity > 0"), bill_of_materials, raw_inventory), "material-needs"
    )
    per_run = needs.groupBy("production_order_id").agg(
        F.max(F.col("stock_qty").isNull()).alias("_no_stock"),
        F.max(F.coalesce(F.col("required_qty") <= 0, F.lit(False))).alias("_nothing"),
        F.max(F.col("required_qty").isNull()).alias("_wide"),
        money_or_null(total(F.sum(line_total(F.col("required_qty"), F.col("unit_cost"))))).alias("total_cost"),
    )
    code = (
        F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), 52001)
        .when(F.col("_product").isNull(), 52002)
        .when(F.col("_no_stock").isNull(), 52003)
        .when(F.col("_no_stock"), 52004)
        .when(F.col("_wide") | F.col("total_cost").isNull(), OVERFLOW)
    )
    checked = materialise(
        requests.join(known, "product_id", "left")
        .join(per_run, "production_order_id", "left")
        .withColumn("_code", code)
        .drop("_product", "_no_stock", "_wide"),
        "runs",
    )
    candidates = checked.filter(F.col("_code").isNull()).select("production_order_id", "_nothing")
    accepted = accept_in_order(
        needs.join(candidates, "production_order_id").select(
            F.col("production_order_id").alias("seq"),
            F.col("raw_material_id").alias("key"),
            F.col("required_qty").alias("need"),
            F.col("stock_qty").alias("stock"),
            (~F.col("_nothing")).alias("takes"),
        )
    ).withColumnRenamed("seq", "production_order_id")
    # A need that rounds to zero breaks the quantity > 0 constraint of consumption lines.
    final = (
        F.when(F.col("_code").isNotNull(), F.col("_code"))
        .when(~F.col("accepted"), 52005)
        .when(F.col("_nothing"), 547)
    )
    outcome = materialise(
        checked.join(accepted, "production_order_id", "left").select(
            *requests.columns, final.alias("reason_code"), "total_cost"
        ),
        "run-outcome",
    )
    done = outcome.filter(F.col("reason_code").isNull())
    today = F.lit(as_of).cast("date")
    orders = done.select(
        "production_order_id",
        "product_id",
        F.coalesce("order_date", today).alias("order_date"),
        F.col("quantity").alias("planned_qty"),
        F.col("quantity").alias("produced_qty"),
        today.alias("completion_date"),
        F.lit("completed").alias("status"),
        "total_cost",
    )
    used = needs.join(done.select("production_order_id"), "production_order_id", "left_semi")
    consumption = used.select(
        "production_order_id", "raw_material_id", F.col("required_qty").alias("quantity"), "unit_cost"
    )
    made = done.select(
        F.col("production_order_id").alias("seq"), "product_id", F.col("quantity").alias("qty"), F.col("total_cost")
    )
    last = done.groupBy("product_id").agg(
        F.max_by(per_unit(F.col("total_cost"), F.col("quantity")), "production_order_id").alias("_cost")
    )
    priced = (
        products.join(last, "product_id", "left")
        .withColumn("standard_cost", F.coalesce("_cost", "standard_cost"))
        .select(*products.columns)
    )
    issued = consumption.select("raw_material_id", F.col("quantity").alias("qty"))
    return Outputs(
        {
            "outcome": lambda: outcome.select(*requests.columns, "reason_code"),
            "production_orders": lambda: orders,
            "production_consumption": lambda: consumption,
            "raw_inventory": lambda: issue_stock(raw_inventory, issued, "raw_material_id"),
            "finished_inventory": lambda: merge_receipts(finished_inventory, made, "product_id")["inventory"],
            "products": lambda: priced,
        }
    )
