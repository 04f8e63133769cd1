"""Upserts as new DataFrames: stock with moving average cost, keyed overwrite, guarded updates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, QUANTITY, cents, moving_avg_cost, zero_if_null
from tallyworks.operators.cash import BALANCE
from tallyworks.operators.fold import Fold, Pair, ordered_fold, pair_fold
from tallyworks.operators.scan import split_limit
from tallyworks.session import materialise


def merge_receipt(inventory: DataFrame, receipt: DataFrame, key: str) -> DataFrame:
    """Merge one receipt (key, qty, total_cost), unique by key, into stock rows.

    A stock row that exists is averaged with the receipt; a new key starts from zero.
    """
    stock = zero_if_null(F.col("quantity"), QUANTITY)
    cost = zero_if_null(F.col("avg_cost"), MONEY)
    received = F.col("qty").isNotNull()
    return (
        inventory.select(key, "quantity", "avg_cost")
        .join(receipt.select(key, "qty", "total_cost"), key, "full_outer")
        .select(
            key,
            F.when(received, F.round(stock + F.col("qty"), 3)).otherwise(stock).cast(QUANTITY).alias("quantity"),
            F.when(received, moving_avg_cost(stock, cost, F.col("qty"), F.col("total_cost")))
            .otherwise(cost)
            .alias("avg_cost"),
        )
    )


def _average(stock: int, avg: int, qty: int, cost: int) -> tuple[int, int]:
    """Moving average in cents: stock and qty in thousandths, cost in hundred-thousandths."""
    pool = stock + qty
    after = (2 * (stock * avg + cost) + pool) // (2 * pool) if pool else 0
    return after, after


def _averages(stock: int, averages: np.ndarray, qty: int, cost: int) -> np.ndarray:
    """``_average`` for many averages before one receipt."""
    pool = stock + qty
    largest = max(abs(int(averages[0])), abs(int(averages[-1])))
    if len(averages) > 1 and pool and 2 * (abs(stock) * largest + abs(cost)) + abs(pool) < 1 << 62:
        return (2 * (stock * averages + cost) + pool) // (2 * pool)
    # One average, or products beyond 64 bits.
    return np.array([_average(stock, a, qty, cost)[0] for a in averages.tolist()], np.int64)


def _average_bounds(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Bounds of the average at the start of each chunk.

    Rounding moves the average by half a cent a receipt at most, and what earlier receipts added
    to the error only shrinks as stock grows. Besides, if every receipt has a quantity, the
    average lies between the smallest and the largest of the opening average and the unit costs.
    """
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    unit = F.when(F.col("_qty") > 0, F.col("_cost") / F.col("_qty"))
    chunks = (
        rows.groupBy(key, "_chunk")
        .agg(
            F.min("_base").alias("_stock"),
            F.min("_open").alias("_opening"),
            F.count(F.lit(1)).alias("_rows"),
            F.sum("_qty").alias("_in"),
            F.sum(F.col("_cost").cast(wide)).cast(wide).alias("_spent"),
            F.min("_qty").alias("_least"),
            F.floor(F.min(unit)).alias("_cheap"),
            F.ceil(F.max(unit)).alias("_dear"),
        )
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_start_base", F.col("_stock") + F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    )
    opening = F.col("_opening")
    value = F.col("_stock").cast("double") * opening + F.coalesce(F.sum("_spent").over(earlier).cast("double"), F.lit(0.0))
    exact = F.when(F.col("_start_base") != 0, value / F.col("_start_base")).otherwise(0.0)
    # Two cents for the rounding of doubles.
    error = F.col("_before") / 2 + 2
    regular = (F.min("_least").over(earlier) > 0) & (F.col("_stock") >= 0)
    lowest = F.when(regular, F.least(opening, F.min("_cheap").over(earlier) - 1))
    highest = F.when(regular, F.greatest(opening, F.max("_dear").over(earlier) + 1))
    first = F.col("_before") == 0
    return chunks.select(
        key,
        "_chunk",
        "_start_base",
        "_opening",
        F.when(first, opening).otherwise(F.greatest(F.floor(exact - error), lowest)).cast("bigint").alias("_low"),
        F.when(first, opening).otherwise(F.least(F.ceil(exact + error), highest)).cast("bigint").alias("_high"),
        # Out of a stock below zero, a higher average may lead to a lower one.
        (F.min("_stock").over(Window.partitionBy(key)) < 0).alias("_every"),
    )


def _average_lanes(stock: np.ndarray, averages: np.ndarray, qty: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_average`` for one receipt of each of many keys."""
    pool = stock + qty
    size = 2.0 * (np.abs(stock.astype(float)) * np.abs(averages.astype(float)) + np.abs(cost.astype(float)))
    after = (2 * (stock * averages + cost) + pool) // np.where(pool == 0, 1, 2 * pool)
    after[pool == 0] = 0
    for i in np.flatnonzero(size + np.abs(pool.astype(float)) >= 2.0**61):  # products beyond 64 bits
        after[i] = _average(int(stock[i]), int(averages[i]), int(qty[i]), int(cost[i]))[0]
    return after, after


AVERAGE = Fold(
    step=_average, bounds=_average_bounds, many=_averages, inputs=("_qty", "_cost"), delta="_qty", lanes=_average_lanes
)


def _card_step(stock: int, avg: int, qty: int, cost: int) -> tuple[int, int]:
    """A receipt moves the average, an issue (qty below zero) leaves it."""
    return _average(stock, avg, qty, cost) if qty > 0 else (avg, avg)


def _card_steps(stock: int, averages: np.ndarray, qty: int, cost: int) -> np.ndarray:
    return _averages(stock, averages, qty, cost) if qty > 0 else averages


def _card_bounds(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Bounds of the average at the start of each chunk: it lies between the opening average and the unit
    costs of the receipts so far, as the stock is never below zero."""
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.when(F.col("_qty") > 0, F.col("_cost") / F.col("_qty"))
    chunks = rows.groupBy(key, "_chunk").agg(
        F.min("_base").alias("_stock"),
        F.min("_open").alias("_opening"),
        F.sum("_qty").alias("_moved"),
        F.floor(F.min(unit)).alias("_cheap"),
        F.ceil(F.max(unit)).alias("_dear"),
    )
    return chunks.select(
        key,
        "_chunk",
        (F.col("_stock") + F.coalesce(F.sum("_moved").over(earlier), F.lit(0))).alias("_start_base"),
        "_opening",
        F.least("_opening", F.min("_cheap").over(earlier) - 1).cast("bigint").alias("_low"),
        F.greatest("_opening", F.max("_dear").over(earlier) + 1).cast("bigint").alias("_high"),
        F.lit(False).alias("_every"),
    )


CARD = Fold(step=_card_step, bounds=_card_bounds, many=_card_steps, inputs=("_qty", "_cost"), delta="_qty")


def _stock_step(stock: int, avg: int, signed: int, cost: int) -> tuple[int, int, int]:
    """Quantity and average together; an issue beyond the stock leaves both."""
    after, passed = BALANCE.step(0, stock, signed)
    return after, _card_step(stock, avg, signed, cost)[0], passed


def _stock_lanes(stock: np.ndarray, averages: np.ndarray, signed: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, ...]:
    after, passed = BALANCE.lanes(0, stock, signed)
    received = signed > 0
    moved = _average_lanes(stock, averages, np.where(received, signed, 0), cost)[0]
    return after, np.where(received, moved, averages), passed


STOCK = Pair(_stock_step, _stock_lanes)


def stock_card(inventory: DataFrame, events: DataFrame, key: str) -> dict[str, DataFrame]:
    """Receipts and issues of stock one after the other.

    ``events`` holds ``seq`` (unique), the key, ``kind`` (receipt or issue), ``qty`` and, for receipts,
    ``total_cost``. A receipt moves the average cost, an issue takes the average of its moment. An issue beyond
    the stock is refused (52005), so whether later ones pass depends on it. Quantities and averages are folded
    together; only of keys beyond the split limit quantities, which do not depend on averages, come first and the
    averages along them. An event of another kind, without a
    key, with a quantity that is null or not positive, or a receipt with a null or negative cost is refused (547). An
    item without a stock row starts from zero; stock rows must not be below zero.

    Returns ``card`` (the events with ``reason_code``, ``quantity_after``, ``avg_cost_after`` and, for
    issues, ``issue_cost``, the unrounded quantity times the average; null for refused events) and the new ``inventory``.
    """
    opened = inventory.select(
        key, (F.col("quantity") * 1000).cast("bigint").alias("_stock"), (F.col("avg_cost") * 100).cast("bigint").alias("_avg")
    )
    zero = F.lit(0).cast("bigint")
    receipt = F.col("kind") == "receipt"
    usable = (
        F.col(key).isNotNull()
        & (F.col("qty") > 0)
        & (receipt & (F.col("total_cost") >= 0) | (F.col("kind") == "issue"))
    )
    checked = materialise(events.withColumn("_usable", F.coalesce(usable, F.lit(False))), "stock-events")
    amount = (F.col("qty") * 1000).cast("bigint")
    cost = F.when(receipt, F.col("total_cost") * 100000).otherwise(0).cast("bigint").alias("_cost")
    rows = checked.filter("_usable").join(opened, key, "left").select(
        *events.columns,
        F.when(receipt, amount).otherwise(-amount).alias("_signed"),
        F.coalesce("_stock", zero).alias("_stock"),
        F.coalesce("_avg", zero).alias("_avg"),
    )
    counts = checked.filter("_usable").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > split_limit(events)).select(key)
    few = rows
    split = not large.isEmpty()
    if split:
        large = F.broadcast(materialise(large, "stock-keys"))  # at most rows / limit of them
        few = rows.join(large, key, "left_anti")
    opening = few.select(*events.columns, "_signed", cost, F.col("_stock").alias("_base"), F.col("_avg").alias("_open"))
    folded = pair_fold(opening, key, ["seq"], STOCK, ["_signed", "_cost"], ["_result", "_after", "_state"])
    if split:
        folded = folded.select(*events.columns, "_result", "_after", "_state").unionByName(
            _card_of_large(rows.join(large, key, "left_semi"), events.columns, cost, key)
        )
    passed = F.col("_result") == 1
    reason = F.when(~passed, 52005)
    after = (F.col("_after").cast("decimal(15,0)") * F.lit("0.001").cast("decimal(3,3)")).cast(QUANTITY)
    average = cents(F.col("_state"))
    done = folded.select(
        *events.columns,
        reason.cast("int").alias("reason_code"),
        F.when(passed, after).alias("quantity_after"),
        F.when(passed, average).alias("avg_cost_after"),
        F.when(passed & ~receipt, F.col("qty").cast(QUANTITY) * average).cast("decimal(29,5)").alias("issue_cost"),
    )
    unusable = checked.filter("not _usable").select(
        *events.columns,
        F.lit(547).alias("reason_code"),
        F.lit(None).cast(QUANTITY).alias("quantity_after"),
        F.lit(None).cast(MONEY).alias("avg_cost_after"),
        F.lit(None).cast("decimal(29,5)").alias("issue_cost"),
    )
    card = materialise(done.unionByName(unusable), "stock-card")
    last = card.filter("reason_code is null").groupBy(key).agg(
        F.max_by("quantity_after", "seq").alias("_quantity"), F.max_by("avg_cost_after", "seq").alias("_average")
    )
    stock = inventory.select(key, "quantity", "avg_cost").join(last, key, "full_outer")
    return {
        "card": card,
        "inventory": stock.select(
            key,
            F.coalesce("_quantity", "quantity").cast(QUANTITY).alias("quantity"),
            F.coalesce("_average", "avg_cost").cast(MONEY).alias("avg_cost"),
        ),
    }


def _card_of_large(rows: DataFrame, names: list[str], cost: Column, key: str) -> DataFrame:
    """``_result``, ``_after`` and ``_state`` of keys beyond the split limit: quantities first, then averages."""
    zero = F.lit(0).cast("bigint")
    opening = rows.withColumns({"_none": zero, "_base": zero, "_open": F.col("_stock")})
    moved = materialise(ordered_fold(opening, key, ["seq"], BALANCE), "stock-moves")
    passed = moved.filter("_result = 1").select(
        *names,
        F.col("_signed").alias("_qty"),
        cost,
        F.col("_state").alias("_after"),
        F.col("_stock").alias("_base"),
        F.col("_avg").alias("_open"),
    )
    folded = ordered_fold(passed, key, ["seq"], CARD, counted=moved)
    done = folded.select(*names, F.lit(1).cast("bigint").alias("_result"), "_after", "_state")
    return done.unionByName(
        moved.filter("_result = 0").select(*names, "_result", F.col("_state").alias("_after"), zero.alias("_state"))
    )


def merge_receipts(inventory: DataFrame, receipts: DataFrame, key: str) -> dict[str, DataFrame]:
    """Merge many receipts (seq, key, qty, total_cost) one after the other by ``seq``.

    The cost is rounded after every receipt, so order matters. Returns ``receipts`` with
    ``avg_cost_after`` and the new ``inventory``.
    """
    opened = inventory.select(
        key,
        F.coalesce(F.col("quantity") * 1000, F.lit(0)).cast("bigint").alias("_base"),
        F.coalesce(F.col("avg_cost") * 100, F.lit(0)).cast("bigint").alias("_open"),
    )
    rows = (
        receipts.join(opened, key, "left")
        .withColumn("_base", F.coalesce("_base", F.lit(0).cast("bigint")))
        .withColumn("_open", F.coalesce("_open", F.lit(0).cast("bigint")))
        .withColumn("_qty", (F.col("qty") * 1000).cast("bigint"))
        .withColumn("_cost", (F.col("total_cost") * 100000).cast("bigint"))
    )
    avg = cents(F.col("_state"))
    folded = materialise(
        ordered_fold(rows, key, ["seq"], AVERAGE, counted=receipts).select(*receipts.columns, avg.alias("avg_cost_after")), "receipts"
    )
    last = folded.groupBy(key).agg(
        F.sum("qty").alias("_received"), F.max_by("avg_cost_after", "seq").alias("_avg")
    )
    stock = (
        inventory.select(key, "quantity", "avg_cost")
        .join(last, key, "full_outer")
        .select(
            key,
            F.round(F.coalesce("quantity", F.lit(0)) + F.coalesce("_received", F.lit(0)), 3)
            .cast(QUANTITY)
            .alias("quantity"),
            F.coalesce("_avg", "avg_cost").cast(MONEY).alias("avg_cost"),
        )
    )
    return {"receipts": folded, "inventory": stock}


def issue_stock(inventory: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Take issues (key, qty), any number of rows per key, out of stock; the average cost stays."""
    out = issues.groupBy(key).agg(F.sum("qty").alias("_issued"))
    return (
        inventory.join(out, key, "left")
        .withColumn("quantity", F.round(F.col("quantity") - F.coalesce("_issued", F.lit(0)), 3).cast(QUANTITY))
        .select(*inventory.columns)
    )


#: Reason code of a source row whose key another source row has too: a merge may touch a row only once.
REPEATED_KEY = 8672


def upsert_or_refuse(
    target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``upsert`` of a source whose keys may repeat, and the refused source rows (``reason_code``).

    All rows of a repeated key are refused, or, with ``order`` (columns of the source), all but the
    last in that order (of equals any one); ordering columns that the target lacks are not written. Rows with a
    null in their key never match a target row or each other, as in SQL, so they are all added.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    counted = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *([F.max(_last(source, order)).alias("_keep")] if order else []))
    # Only repeated keys come into the join, one row each.
    repeated = counted.filter(whole & (F.col("_n") > 1))
    written = source.columns if not order else [c for c in source.columns if c in target.columns]
    marked = source.join(repeated, keys, "left")
    single = marked.filter(F.col("_n").isNull()).select(*written)
    lost = marked.filter(F.col("_n").isNotNull()).select(*source.columns)
    if order:
        picked = repeated.select(*(F.col(f"_keep.{c}").alias(c) for c in source.columns))
        single = single.unionByName(picked.select(*written))
        # One copy of the picked row stays out of the refused ones.
        lost = lost.exceptAll(picked)
    return upsert(target, single, keys), lost.withColumn("reason_code", F.lit(REPEATED_KEY))


def _last(source: DataFrame, order: list[str]) -> Column:
    """A struct that is largest for the last row; it carries the row."""
    return F.struct(*order, *(c for c in source.columns if c not in order))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows with the same keys and are added otherwise.

    Columns the source lacks keep the target's value. The keys of the source must be unique
    (``upsert_or_refuse`` sees to that); a null in a key matches nothing.
    """
    s = source.withColumn("_new", F.lit(True))
    for c in source.columns:
        if c not in keys:
            s = s.withColumnRenamed(c, f"_s_{c}")
    joined = target.join(s, keys, "full_outer")
    return joined.select(
        *[
            F.when(F.col("_new"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
            if c in source.columns and c not in keys
            else F.col(c)
            for c in target.columns
        ]
    )


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set columns on the rows that meet the condition."""
    flagged = df.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    return flagged.withColumns(
        {c: F.when(F.col("_hit"), v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}
    ).drop("_hit")
