"""All-or-nothing acceptance of documents against a falling stock, in document order.

A document is accepted when every item it needs is in stock after the documents accepted
before it; a refused document takes nothing. Serving one document at a time is replaced by
rounds over all undecided documents. A round

- accepts a document if each of its needs fits even when every undecided earlier document were
  accepted too;
- refuses it if some need does not fit after the accepted earlier documents alone.

If that decides too little, the next round also serves documents one by one, as streams: documents
that contend for the same items, directly or through others, are one group, and groups do not
touch each other, so each is a stream of its own. Of groups beyond the block size the earliest
block of rows is served. Each decision is the one the serial order would take.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.operators.groups import connected
from tallyworks.operators.scan import Parts, before, chunked
from tallyworks.session import materialise

BLOCK_ROWS = 1_000_000


def accept_in_order(needs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(seq, accepted) for every document in ``needs``.

    ``needs`` has one row per (seq, key): ``need`` and ``stock`` (decimal(14,3)), and
    ``takes``, false for a document that is refused later for other reasons and so leaves
    the stock as it is. A stream serves ``block_rows`` rows at most, and the rest of the
    document that the last of them belongs to. A quarter of that is served without another round.
    """
    undecided = F.col("state") == "undecided"
    nothing = F.lit(0).cast("decimal(14,3)")
    taken = F.when(F.col("takes"), F.col("need")).otherwise(nothing)
    claims = materialise(needs.filter("seq is not null").select("seq", "key", "need", "stock", "takes"), "claims")
    if not claims.filter("key is null or need is null or stock is null").isEmpty():
        raise ValueError("needs without key, need or stock cannot be decided")
    parts = chunked(claims, "key", ["seq"], "needs")
    live = parts.rows.withColumnRenamed("stock", "left").withColumn("state", F.lit("undecided"))
    decided = claims.select("seq", F.lit(True).alias("accepted")).limit(0)
    last_rows = None
    while True:
        scanned = before(
            Parts(live, parts.split),
            "key",
            ["seq"],
            {
                "_accepted": F.when(F.col("state") == "accepted", taken).otherwise(nothing),
                "_waiting": F.when(undecided, taken).otherwise(nothing),
            },
        )
        open_rows = materialise(_open_rows(scanned), "round-rows")
        rows = open_rows.count()
        if rows == 0:
            break
        if rows <= block_rows // 4:
            verdicts = _served(open_rows.withColumn("group", F.lit(0).cast("bigint")))
        elif last_rows is None or rows <= last_rows * 3 // 4:
            verdicts = _bounded(open_rows)
        else:
            now, later = _blocks(open_rows, block_rows)
            verdicts = _served(now).unionByName(_bounded(later))
        last_rows = rows
        verdicts = materialise(verdicts, "round")
        decided = decided.unionByName(verdicts.filter(~undecided).select("seq", (F.col("state") == "accepted").alias("accepted")))
        live = open_rows.join(verdicts.filter("state <> 'refused'"), "seq").select(
            "seq", "key", "need", "left", "takes", "_chunk", verdicts["state"]
        )
    return decided


def _bounded(rows: DataFrame) -> DataFrame:
    """(seq, state) by the bounds of what earlier documents can take."""
    bounds = rows.groupBy("seq").agg(
        F.min(F.col("_waiting") + F.col("need") <= F.col("left")).alias("fits"),
        F.max(F.col("need") > F.col("left")).alias("short"),
    )
    state = F.when(F.col("short"), "refused").when(F.col("fits"), "accepted").otherwise("undecided")
    return bounds.select("seq", state.alias("state"))


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows to serve now, with their ``group``, and the others: the later rows of groups beyond the block size.

    An item that suffices for all that want it does not connect its documents.
    """
    short = rows.groupBy("key").agg(
        F.max(F.col("_waiting") + F.col("need") > F.col("left")).alias("_short"), F.min("seq").alias("first")
    )
    links = rows.select("seq", "key").join(short.filter("_short"), "key").select("seq", "first").distinct()
    groups = connected(links, "seq", "first")
    grouped = materialise(
        rows.join(groups.select(F.col("id").alias("seq"), F.col("root").alias("group")), "seq", "left").withColumn(
            "group", F.coalesce("group", "seq")
        ),
        "round-groups",
    )
    large = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select("group")
    beyond = grouped.join(large, "group", "left_semi")
    last = beyond.select("seq").orderBy("seq").limit(block_rows).agg(F.max("seq")).first()[0]
    if last is None:
        return grouped, grouped.limit(0)
    return (
        grouped.join(large, "group", "left_anti").unionByName(beyond.filter(F.col("seq") <= last)),
        beyond.filter(F.col("seq") > last),
    )


def _served(rows: DataFrame) -> DataFrame:
    """(seq, state) of documents served one by one, each group for itself."""
    claims = rows.select(
        "group",
        "seq",
        "key",
        (F.col("need") * 1000).cast("bigint").alias("need"),
        (F.col("left") * 1000).cast("bigint").alias("left"),
        "takes",
    )
    served = claims.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(_serve, "seq bigint, accepted boolean")
    return served.select("seq", F.when(F.col("accepted"), "accepted").otherwise("refused").alias("state"))


def _open_rows(scanned: DataFrame) -> DataFrame:
    """Undecided rows, with the stock that the documents accepted before them have left."""
    return scanned.filter("state = 'undecided'").withColumn(
        "left", (F.col("left") - F.col("_accepted")).cast("decimal(14,3)")
    ).drop("_accepted", "state")


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Serve the documents of one sorted partition one by one; a group shares no scarce item with another."""
    gone: dict[int, int] = {}
    group, at, items = None, None, []

    def decide() -> bool:
        fits = all(need + gone.get(key, 0) <= left for key, need, left, _ in items)
        if fits:
            for key, need, _, takes in items:
                if takes:
                    gone[key] = gone.get(key, 0) + need
        return fits

    def answers(seqs: list[int], accepted: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(accepted, pa.bool_())], names=["seq", "accepted"])

    for batch in batches:
        seqs, accepted = [], []
        for of, seq, *item in zip(*[column.to_pylist() for column in batch.columns]):
            if seq != at:
                if items:
                    seqs.append(at)
                    accepted.append(decide())
                at, items = seq, []
            if of != group:
                group = of
                gone.clear()
            items.append(item)
        yield answers(seqs, accepted)
    if items:
        yield answers([at], [decide()])
