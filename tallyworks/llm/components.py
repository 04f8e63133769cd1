"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or not larger) neighbours of every number on its smallest neighbour."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("a", "b")
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    # A joined pair, not a window: a number with very many neighbours is split by the join.
    hung = both.join(smallest, "a")
    moved = hung.filter(F.col("b") > F.col("a")) if large else hung.filter(F.col("b") != F.col("root"))
    out = moved.select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not large:
        out = out.union(smallest.select("a", F.col("root").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """``id`` and ``root`` (the smallest connected number) of every number in ``links`` (a, b).

    Alternates two star operations until nothing changes; the rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder.
    """
    current = materialise(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        current = materialise(_star(materialise(_star(current, True), label), False), label)
    return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
