"""Physical plans: pushed filters, narrow scans, no shuffle where none is needed."""

import re

from tallyworks.operators import credit
from tallyworks.plans import queries
from tallyworks.sources.adapters import StarBooks

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_read_only_used_columns(spark):
    text = plan(queries.QUERIES["sales_summary"](spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = [s for s in schemas if "l_orderkey" in s][0]
    assert sorted(c.split(":")[0] for c in lineitem.split(",")) == ["l_extendedprice", "l_orderkey", "l_quantity"]


def test_filters_reach_the_scan(spark):
    text = plan(queries.QUERIES["period_summary"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in text
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_schedule_has_no_shuffle(spark):
    loans = queries._loans(StarBooks(spark, FOLDER))
    assert "Exchange" not in plan(credit.build_schedule(loans))


def test_no_cross_joins(spark):
    for name in ("company_kpi_monthly", "period_summary", "sales_summary", "bom_explosion", "sale_lines_priced"):
        text = plan(queries.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_monthly_report_computes_each_source_once(spark):
    text = plan(queries.QUERIES["company_kpi_monthly"](spark, FOLDER))
    # lines are scanned once for sales and once for purchases, events once for timesheets
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", text)) == 2
    assert len(re.findall(r"ReadSchema: struct<ts:", text)) == 1


def test_audit_broadcasts_no_table_that_grows(spark):
    """Files hold few bytes for a row, so tables of many million rows look small: only the one of positions may be sent around."""
    text = queries.QUERIES["dq_audit_references"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    joins = [(kind, keys) for kind, keys in re.findall(r"(\w+Join)(?:\(\w+=\w+\))? \[([^\]]*)\]", text)]
    assert {re.sub(r"#\d+L?", "", keys) for kind, keys in joins if kind.startswith("Broadcast")} <= {"position_id", "parent, slot"}
    for key in ("purchase_id", "product_id", "raw_material_id", "employee_id"):
        assert any(kind == "SortMergeJoin" and keys.startswith(key) for kind, keys in joins), key
