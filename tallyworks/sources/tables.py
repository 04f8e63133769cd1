"""Domain tables on storage: typed scans, appends, snapshots, named views, surrogate keys."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.schemas import AMOUNTS, TABLES
from tallyworks.session import materialise


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def rows(spark: SparkSession, name: str, values: list[tuple], columns: str | None = None) -> DataFrame:
    """Literal rows of a domain table. ``columns`` (space-separated) names the given columns;
    the others are null."""
    full = schema_of(name)
    given = columns.split() if columns else full.fieldNames()
    part = T.StructType([full[c] for c in given])
    df = spark.createDataFrame(values, part)
    return df.select(*[F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in full])


def with_amounts(df: DataFrame, name: str) -> DataFrame:
    """Add the computed amount column of the table, if it has one."""
    if name not in AMOUNTS:
        return df
    column, expr = AMOUNTS[name]
    return df.withColumn(column, F.expr(expr))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table of a snapshot with its declared schema."""
    return with_amounts(spark.read.schema(schema_of(name)).parquet(os.path.join(folder, name)), name)


def read_snapshot(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, all 24 unless named."""
    return {name: read_table(spark, folder, name) for name in names or TABLES}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A domain table without rows, to start a company's books."""
    return spark.createDataFrame([], schema_of(name))


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    """Append rows to a table of a snapshot."""
    stored = [c for c in schema_of(name).fieldNames() if c in df.columns]
    df.select(*stored).write.mode("append").parquet(os.path.join(folder, name))


def write_snapshot(tables: Mapping[str, DataFrame], folder: str) -> str:
    """Write the tables of one finished batch under a new folder and return it.

    State is never rewritten in place: readers keep the old folder until they are given
    the new one. A folder that exists already is refused.
    """
    for name, df in tables.items():
        stored = [c for c in schema_of(name).fieldNames() if c in df.columns]
        df.select(*stored).write.mode("error").parquet(os.path.join(folder, name))
    return folder


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Expose reports to ``spark.sql`` under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def assign_keys(df: DataFrame, key: str, order: list[str], start: int = 0) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in the given order, which must be total.

    All rows form one sequence, numbered in two passes at every size: the rows are range-partitioned by
    the order and written once, each partition is counted, and a row's number is the rows of the
    partitions before its own plus its place inside. Rows that are equal in the order share a partition.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    written = materialise(ranged, "keys")
    counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = written.withColumn("_inside", inside).join(bases, "_part")
    return placed.withColumn(key, (F.lit(start) + F.col("_base") + F.col("_inside")).cast("bigint")).drop(
        "_part", "_base", "_inside"
    )
