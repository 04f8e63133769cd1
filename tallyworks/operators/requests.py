"""Several requests for one thing in a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Refusals that may end differently on another try: unknown account, too little cash.
RETRIED = (50003, 50004, 50005)


def first_requests(requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The requests marked with the first ``seq`` of their keys, and those that are tried. Requests
    with a null key stand for themselves, so every one of them is tried."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    first = requests.filter(whole).groupBy(*keys).agg(F.min("seq").alias("_first"))
    marked = requests.join(first, keys, "left").withColumn("_first", F.coalesce("_first", "seq"))
    return marked, marked.filter(F.col("seq") == F.col("_first")).drop("_first")


def repeated_requests(
    marked: DataFrame, outcome: DataFrame, keys: list[str], done: int
) -> tuple[DataFrame, DataFrame]:
    """Answers to the repeated requests (seq, keys, reason_code) given the outcome of the first ones, and
    the requests that have no answer yet. ``done`` is the code after an accepted first request."""
    repeats = marked.filter(F.col("seq") > F.col("_first"))
    told = outcome.select(F.col("seq").alias("_first"), F.col("reason_code").alias("_code"))
    answered = repeats.join(told, "_first")
    again = F.coalesce(F.col("_code").isin(*RETRIED), F.lit(False))
    code = F.coalesce("_code", F.lit(done)).alias("reason_code")
    return answered.filter(~again).select("seq", *keys, code), answered.filter(again).drop("_first", "_code")
