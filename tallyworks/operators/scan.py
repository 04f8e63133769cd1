"""Running totals per key that stay parallel when one key holds most of the rows.

A window sorts all rows of a key in one task. That is right while a key has few rows, and
the row counts are checked first. Keys beyond the limit are cut: their rows are range-partitioned
by (key, order) into chunks of about equal size, whatever the keys look like. A chunk holds a
contiguous run of the order, so the total before a row is the total of the earlier chunks of
its key (a small table) plus a window inside the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.session import materialise

SPLIT_SETTING = "tallyworks.split.rows"
SPLIT_ROWS = 4_000_000


@dataclass(frozen=True)
class Parts:
    """Rows with a ``_chunk`` number. Keys with few rows have one chunk, -1; the chunks of the
    others ascend with the order. ``split`` tells whether there are any of the latter."""

    rows: DataFrame
    split: bool

    def cut(self) -> DataFrame:
        """The rows of the keys that were cut."""
        return self.rows.filter("_chunk >= 0")


def split_limit(df: DataFrame) -> int:
    """Most rows of one key that a single task may get."""
    return int(df.sparkSession.conf.get(SPLIT_SETTING, str(SPLIT_ROWS)))


def chunked(
    df: DataFrame, key: str, order: list[str], label: str = "chunks", counted: DataFrame | None = None
) -> Parts:
    """Label the rows with chunks; (key, order) must be unique.

    ``counted`` may name a cheaper table with at least as many rows of every key.

    The bounds of the chunks come from a sample, so rows that are cut are written once and
    everything that follows sees the same chunks.
    """
    limit = split_limit(df)
    counts = (df if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    keys, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    whole = F.lit(-1).cast("int").alias("_chunk")
    if keys == 0:
        return Parts(df.select("*", whole), False)
    # Every such key has more than ``limit`` rows, so there are at most total / limit of them.
    large = F.broadcast(materialise(counts.select(key), f"{label}-keys"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // limit + 1)
    ranged = df.join(large, key, "left_semi").repartitionByRange(n, key, *order)
    cut = materialise(ranged.withColumn("_chunk", F.spark_partition_id()), label)
    rest = df.join(large, key, "left_anti").select(*cut.columns[:-1], whole)
    return Parts(cut.unionByName(rest), True)


def earlier_chunks(parts: Parts, key: str, sums: dict[str, Column]) -> DataFrame:
    """Per (key, chunk) of the cut keys, each aggregate accumulated over the earlier chunks.

    The window runs over one row per (key, chunk), at most one per partition for any key.
    """
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.cut().groupBy(key, "_chunk").agg(*[c.alias(name) for name, c in sums.items()])
    return totals.select(
        key,
        "_chunk",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums],
    )


def before(parts: Parts, key: str, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """The rows with, for each named amount, its total over the earlier rows of the key."""
    run = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.rows
    inside = {n: F.coalesce(F.sum(c).over(run), F.lit(0)) for n, c in amounts.items()}
    if not parts.split:
        return rows.withColumns(inside)
    offsets = earlier_chunks(parts, key, {f"_o_{n}": F.sum(c) for n, c in amounts.items()})
    joined = rows.join(offsets, [key, "_chunk"], "left")
    return joined.withColumns(
        {n: c + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n, c in inside.items()}
    ).drop(*[f"_o_{n}" for n in amounts])
