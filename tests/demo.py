"""A small company: inputs of one full business cycle.

Fixed values: the scenario inputs listed in FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import SparkSession

from tallyworks.sources.tables import rows

TODAY = dt.date(2026, 3, 10)


def day(n: int) -> dt.date:
    return TODAY + dt.timedelta(days=n)


def tables(spark: SparkSession) -> dict:
    materials = ["Cotton", "Polyester", "Thread", "Buttons", "Zips", "Elastic"]
    minimum = [500, 300, 100, 1000, 500, 200]
    products = [("TSHIRT-UNI", "T-shirt", 8500), ("HOODIE-UNI", "Hoodie", 16500), ("PANTS-SPR", "Pants", 12500)]
    recipe = [(1, 1, "1.20"), (1, 3, "0.05"), (2, 2, "1.80"), (2, 3, "0.08"), (2, 5, "1.00"), (3, 2, "1.40"),
              (3, 3, "0.06"), (3, 6, "0.70")]
    january = [(1, 22, 15000, 0), (2, 21, 10000, 5000), (3, 22, 12000, 0), (4, 22, 20000, 0), (5, 22, 0, 0)]
    jan = dt.date(2026, 1, 1)
    return {
        "cash_accounts": rows(spark, "cash_accounts", [(1, "Main", D(15000000), "KZT")], "account_id account_name balance currency_code"),
        "suppliers": rows(spark, "suppliers", [(i, f"Supplier {i}") for i in (1, 2, 3)], "supplier_id supplier_name"),
        "raw_materials": rows(spark, "raw_materials", [(i + 1, m, "m", D(q)) for i, (m, q) in enumerate(zip(materials, minimum))],
                              "raw_material_id material_name unit min_stock"),
        "raw_inventory": rows(spark, "raw_inventory", [(i, D(0), D(0)) for i in range(1, 7)], "raw_material_id quantity avg_cost"),
        "products": rows(spark, "products", [(i + 1, s, n, n, D(p), D(0)) for i, (s, n, p) in enumerate(products)],
                         "product_id sku product_name category sale_price standard_cost"),
        "bill_of_materials": rows(spark, "bill_of_materials", [(p, m, D(q)) for p, m, q in recipe]),
        "finished_inventory": rows(spark, "finished_inventory", [(i, D(0), D(0)) for i in (1, 2, 3)], "product_id quantity avg_cost"),
        "customers": rows(spark, "customers", [(i, f"Customer {i}") for i in (1, 2, 3)], "customer_id customer_name"),
        "positions": rows(spark, "positions", [(1, 1, "Sewer", D(220000)), (2, 1, "Cutter", D(210000)), (3, 2, "Sales", D(260000)),
                                               (4, 3, "Accountant", D(300000))]),
        "employees": rows(spark, "employees", [(i, f"Employee {i}", jan, p, True) for i, p in zip(range(1, 6), (1, 2, 1, 3, 4))]),
        "timesheets": rows(spark, "timesheets", [(e, jan, n, D(b), D(x)) for e, n, b, x in january],
                           "employee_id period_month worked_days bonus deductions"),
    }


PURCHASE = """[{"raw_material_id": 1, "quantity": 700, "unit_price": 1450},
 {"raw_material_id": 2, "quantity": 600, "unit_price": 1200}, {"raw_material_id": 3, "quantity": 350, "unit_price": 280},
 {"raw_material_id": 4, "quantity": 3000, "unit_price": 35}, {"raw_material_id": 5, "quantity": 500, "unit_price": 220},
 {"raw_material_id": 6, "quantity": 400, "unit_price": 500}]"""
SALES = [
    '[{"product_id": 1, "quantity": 120, "unit_price": 9000}, {"product_id": 2, "quantity": 50, "unit_price": 17500}]',
    '[{"product_id": 3, "quantity": 70}]',
]
FEBRUARY = [(1, 22, 18000, 0), (2, 20, 12000, 5000), (3, 22, 10000, 0), (4, 22, 25000, 0), (5, 22, 0, 0)]
