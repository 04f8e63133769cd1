"""JSON item lists as line rows.

A document is a header row (``doc_id`` and its attributes) and any number of pages
(``doc_id``, ``items_json``). A page is a JSON list of flat objects; a single object counts
as a list of one. A short document has one page; a long one may be cut into many, so no
document has to fit in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Item fields of purchase and sale documents.
PURCHASE_ITEM = "raw_material_id bigint, quantity decimal(14,3), unit_price decimal(14,2)"
SALE_ITEM = "product_id bigint, quantity decimal(14,3), unit_price decimal(14,2)"


def is_bad_json(text: Column, item: str) -> Column:
    """True where a text is present but holds neither a list of objects nor an object."""
    return text.isNotNull() & F.from_json(text, f"array<struct<{item}>>").isNull()


def page_lines(pages: DataFrame, item: str) -> DataFrame:
    """(doc_id, bad_json, item) rows: one per item, and one with a null item for a page without any."""
    parsed = pages.select(
        "doc_id", "items_json", F.from_json("items_json", f"array<struct<{item}>>").alias("items")
    )
    # Two uses of the parsed column, so that Spark parses once and keeps the projections apart.
    return parsed.select(
        "doc_id",
        (F.col("items_json").isNotNull() & F.col("items").isNull()).alias("bad_json"),
        F.explode_outer("items").alias("item"),
    )


def item_lines(pages: DataFrame, item: str) -> DataFrame:
    """The item rows alone, with the item fields as columns."""
    return pages.select("doc_id", F.inline(F.from_json("items_json", f"array<struct<{item}>>")))
