"""JSON pages as line rows."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyworks.sources.documents import SALE_ITEM, is_bad_json, item_lines, page_lines


def test_pages(spark):
    texts = {
        1: '[{"product_id": 1, "quantity": 2.5, "unit_price": 3}, {"product_id": 2, "quantity": 1}]',
        2: '{"product_id": 3, "quantity": 1}',
        3: "[]",
        4: '[{"product_id": 1',
        5: None,
        6: "5",
        7: '[{"product_id": 1, "quantity": "many"}]',
    }
    pages = spark.createDataFrame(list(texts.items()), "doc_id long, items_json string")
    bad = {r.doc_id: r.bad for r in pages.select("doc_id", is_bad_json(F.col("items_json"), SALE_ITEM).alias("bad")).collect()}
    assert bad == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}
    rows = sorted((r.doc_id, r.product_id or 0, r.quantity, r.unit_price) for r in item_lines(pages, SALE_ITEM).collect())
    assert rows == [(1, 1, D("2.500"), D("3.00")), (1, 2, D("1.000"), None), (2, 3, D("1.000"), None), (7, 1, None, None)]
    lines = page_lines(pages, SALE_ITEM).collect()
    assert sorted((r.doc_id, r.bad_json, r.item is None) for r in lines) == [
        (1, False, False), (1, False, False), (2, False, False), (3, False, True), (4, True, True), (5, False, True),
        (6, True, True), (7, False, False)]
