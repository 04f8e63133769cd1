"""Connected groups of numbered things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.session import materialise


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``root``, the smallest number that can be reached, for every number that is not its own root.

    ``links`` (a, b) are pairs of numbers in any direction. A round links all larger neighbours of a number to
    its smallest one, then the number and its smaller neighbours; the rounds grow with the logarithm of the longest
    path. Minima are combined before they are sent and joined back, so a number with very many neighbours is
    spread over tasks. Each half round is written to the shared folder.
    """
    pairs = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    current, mark = materialise(pairs, "links"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == mark:
            return current.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        mark = state
        # Larger neighbours move to the smallest neighbour, or to the number itself if none is smaller.
        least = current.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = current.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select(
            "hi", F.coalesce("least", "lo").alias("lo")
        )
        own = least.select("hi", F.col("least").alias("lo"))
        current = materialise(moved.unionByName(own).distinct(), "links")
        # The smaller neighbours of a number move to the smallest of them, and so does the number.
        least = current.groupBy("hi").agg(F.min("lo").alias("least"))
        hung = current.join(least, "hi")
        smaller = hung.filter("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        own = least.select("hi", F.col("least").alias("lo"))
        current = materialise(smaller.unionByName(own).distinct(), "links")
