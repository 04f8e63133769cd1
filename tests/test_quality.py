"""Constraint checks, upserts and updates on small tables."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from demo import TODAY, tables
from tallyworks.operators import audit, merge, quality
from tallyworks.schemas import TABLES
from tallyworks.sources.tables import rows, schema_of


def test_rules_cover_the_declared_tables(spark):
    assert len(TABLES) == 24
    for (child, column), parent in quality.REFERENCES.items():
        assert column in schema_of(child).fieldNames() and column in schema_of(parent).fieldNames()
    assert len(quality.REFERENCES) == 23


def test_value_state_and_required_rules(spark):
    orders = spark.createDataFrame(
        [(1, "paid", D(1)), (2, "lost", D(1)), (3, None, None)], "sales_id long, status string, total_amount decimal(14,2)")
    found = quality.violations(orders, quality.conditions("sales_orders", ["sales_id", "status"]), ["sales_id"])
    assert sorted((r.rule, r.sales_id) for r in found.collect()) == [
        ("sales_orders.status", 2), ("sales_orders.status_required", 3)]
    sheets = rows(spark, "timesheets", [(1, 1, TODAY, 32, D(0), D(0)), (2, 1, TODAY.replace(day=1), 31, D(0), D(0))])
    found = quality.violations(sheets, quality.conditions("timesheets", sheets.columns), ["timesheet_id"])
    assert sorted((r.rule, r.timesheet_id) for r in found.collect()) == [("timesheets.days", 1), ("timesheets.month_start", 1)]


def test_text_lengths(spark):
    accounts = rows(spark, "cash_accounts", [(1, "a", D(1), "EURO"), (2, "b", D(1), "EUR")], "account_id account_name balance currency_code")
    found = quality.violations(accounts, quality.conditions("cash_accounts", ["currency_code"]), ["account_id"])
    assert [tuple(r) for r in found.collect()] == [("cash_accounts.currency_code_length", 1)]


def test_demo_tables_break_no_rule(spark):
    t = tables(spark)
    for name, df in t.items():
        filled = [c for c in df.columns if c not in ("created_at", "updated_at", "timesheet_id")]
        assert quality.violations(df, quality.conditions(name, filled), [df.columns[0]]).count() == 0
        for keys in quality.UNIQUE.get(name, []):
            assert quality.duplicates(df, keys).count() == 0
    for (child, column), parent in quality.REFERENCES.items():
        if child in t and parent in t:
            assert quality.orphans(t[child], column, t[parent]).count() == 0


def test_orphans_ignore_nulls(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, k long")
    parent = spark.createDataFrame([(1,)], "k long")
    assert [r.id for r in quality.orphans(child, "k", parent).collect()] == [3]
    assert [r.id for r in quality.existing(child, "k", parent).collect()] == [1]


def test_upsert_and_update(spark):
    target = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, note string")
    source = spark.createDataFrame([(2, None), (3, 30)], "k int, v int")
    got = sorted(tuple(r) for r in merge.upsert(target, source, ["k"]).collect())
    assert got == [(1, 10, "a"), (2, None, "b"), (3, 30, None)]
    changed = merge.update_where(target, F.col("v") > 15, note=F.lit("big"))
    assert sorted(tuple(r) for r in changed.collect()) == [(1, 10, "a"), (2, 20, "big")]
    unknown = merge.update_where(target, F.lit(None).cast("boolean"), v=F.lit(0))
    assert sorted(r.v for r in unknown.collect()) == [10, 20]


def test_audit_counts_every_declared_rule(spark):
    """Counts over stacked tables equal the checks made one by one, with planted faults and without."""
    t = tables(spark)
    broken = dict(t)
    broken["cash_accounts"] = t["cash_accounts"].unionByName(
        rows(spark, "cash_accounts", [(None, "x", D(-1), "EURO")], "account_id account_name balance currency_code"), allowMissingColumns=True)
    lines = rows(spark, "bill_of_materials", [(1, 999, D(0)), (1, 999, D(1)), (None, 999, D(1))])
    broken["bill_of_materials"] = t["bill_of_materials"].unionByName(lines)
    for given in (t, broken):
        for rule, n in audit.rule_counts(given).collect():
            name = rule.split(".")[0]
            assert n == given[name].filter(~F.expr(quality.conditions(name, given[name].columns)[rule])).count(), rule
        found = dict(map(tuple, audit.reference_counts(given).collect()))
        asked = {f"{c}.{k}": (c, k, p) for (c, k), p in quality.REFERENCES.items() if c in given and p in given}
        assert set(found) == set(asked)
        for name, (child, column, parent) in asked.items():
            assert found[name] == quality.orphans(given[child], column, given[parent]).count(), name
        for label, repeated, n in audit.key_counts(given).collect():
            name, columns = label.rstrip(")").split("(")
            again = [r.row_count for r in quality.duplicates(given[name], columns.split(", ")).collect()]
            assert (repeated, n) == (len(again), sum(again)), label
    keys = {r.unique_key: tuple(r)[1:] for r in audit.key_counts(broken).collect()}
    assert keys["bill_of_materials(product_id, raw_material_id)"] == (1, 2)
    assert found["bill_of_materials.raw_material_id"] == 3


def test_audited_groups_are_short(spark):
    """References are grouped by two numbers, so that a group takes little memory."""
    plan = audit.reference_counts(tables(spark))._jdf.queryExecution().optimizedPlan()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Aggregate" and node.groupingExpressions().size() == 2:
            found.append([node.groupingExpressions().apply(i).dataType().simpleString() for i in range(2)])
    assert found == [["int", "bigint"]]
