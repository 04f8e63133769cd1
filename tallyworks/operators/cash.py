"""Cash postings: a batch of movements in order, accepted while the account can pay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.money import MONEY, cents
from tallyworks.operators.fold import Fold, Payments, ordered_fold
from tallyworks.operators.scan import before, chunked
from tallyworks.session import materialise


def _pay(_base: int, balance: int, amount: int) -> tuple[int, int]:
    after = balance + amount
    if amount > 0 or after >= 0:
        return after, 1
    return balance, 0


def _pay_lanes(_base: np.ndarray, balances: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_pay`` for one payment of each of many accounts."""
    after = balances + amounts
    if max(int(after.max()), -int(after.min())) >= WIDE:
        raise OverflowError("a balance is beyond 64 bits")
    fits = (amounts > 0) | (after >= 0)
    return np.where(fits, after, balances), fits.astype(np.int64)


#: Balances stay below; payments looked at together, and payments taken singly where passes and refusals alternate.
WIDE = 1 << 61
WINDOW = 1 << 14
SINGLE = 4096


def _pay_run(_base: int, balance: int, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balances and results of consecutive payments of one account: runs that pass are sums, runs that are
    refused leave the balance."""
    states, results = np.empty(len(amounts), np.int64), np.empty(len(amounts), np.int64)
    largest = max(int(amounts.max()), -int(amounts.min()), 1)
    at, width, turns, mark = 0, 64, 0, 0
    while at < len(amounts):
        if abs(balance) >= WIDE or largest >= WIDE:
            raise OverflowError("a balance is beyond 64 bits")
        part = amounts[at : at + max(1, min(width, WIDE // largest))]
        after = balance + np.cumsum(part)
        refused = np.flatnonzero((part <= 0) & (after < 0))
        passed = int(refused[0]) if len(refused) else len(part)
        states[at : at + passed], results[at : at + passed] = after[:passed], 1
        if passed:
            balance = int(after[passed - 1])
        at += passed
        width = min(width * 4, WINDOW) if passed == len(part) else 64
        if len(refused):
            part = amounts[at : at + WINDOW]
            passes = np.flatnonzero((part > 0) | (part >= -balance))
            lost = int(passes[0]) if len(passes) else len(part)
            states[at : at + lost], results[at : at + lost] = balance, 0
            at += lost
        turns += 1
        if turns == 16:
            if at - mark < 16 * 32:
                for i, amount in enumerate(amounts[at : at + SINGLE].tolist(), at):
                    balance, results[i] = _pay(0, balance, amount)
                    states[i] = balance
                at = min(at + SINGLE, len(amounts))
            turns, mark = 0, at
    return states, results


def _balance_bounds(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Bounds of the balance at the start of each chunk, without knowing which payments pass.

    After a payment of ``a`` a balance between L and U lies between max(L - a, 0) and
    max(U - a, a - 1 cent). So each bound is the running sum of all movements plus the
    highest reset so far, and the bounds are never further apart than the largest payment. A balance
    that opens below zero may stay there, as payments are refused, but never falls below its opening.
    """
    run = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    paying = F.col("_signed") < 0
    chunks = (
        rows.withColumn("_run", F.sum("_signed").over(run))
        .groupBy(key, "_chunk")
        .agg(
            F.min("_open").alias("_opening"),
            F.sum("_signed").alias("_total"),
            F.max(F.when(paying, -F.col("_run"))).alias("_least"),
            F.max(F.when(paying, -F.col("_signed") - 1 - F.col("_run"))).alias("_most"),
        )
        .withColumn("_moved", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    )
    resets = {name: F.max(F.col(name) - F.col("_moved")).over(earlier) for name in ("_least", "_most")}
    low, high = (F.col("_moved") + F.greatest("_opening", reset) for reset in resets.values())
    low = F.when(F.col("_opening") < 0, F.least("_opening", low)).otherwise(low)
    base = F.lit(0).cast("bigint").alias("_start_base")
    return chunks.select(key, "_chunk", base, "_opening", low.alias("_low"), high.alias("_high"))


BALANCE = Fold(
    step=_pay, bounds=_balance_bounds, trace=Payments, inputs=("_signed",), delta="_none", lanes=_pay_lanes, run=_pay_run
)


def signed(direction: Column, amount: Column) -> Column:
    return F.when(direction == "in", amount).otherwise(-amount)


def movement_code(known: Column) -> Column:
    """First failing check that does not depend on the balance; null when all pass."""
    bad_direction = F.col("direction").isNull() | ~F.col("direction").isin("in", "out")
    return (
        F.when(F.col("amount").isNull() | (F.col("amount") <= 0), 50001)
        .when(bad_direction, 50002)
        .when(~known & (F.col("direction") == "in"), 50003)
        .when(~known, 50004)
    )


def post_movements(movements: DataFrame, accounts: DataFrame) -> dict[str, DataFrame]:
    """Post movements (seq, account_id, direction, amount, ...) in order of ``seq``.

    Returns ``outcome`` (all movements with reason_code and balance_after), ``accepted`` and
    ``rejected`` parts of it, and ``accounts`` with their new balances.
    """
    opened = accounts.select("account_id", F.col("balance").alias("_opening"))
    checked = movements.join(opened, "account_id", "left").withColumn(
        "reason_code", movement_code(F.col("_opening").isNotNull())
    )
    valid = (
        checked.filter(F.col("reason_code").isNull())
        .withColumn("_signed", (signed(F.col("direction"), F.col("amount")) * 100).cast("bigint"))
        .withColumn("_none", F.lit(0).cast("bigint"))
        .withColumn("_base", F.lit(0).cast("bigint"))
        .withColumn("_open", (F.col("_opening") * 100).cast("bigint"))
    )
    folded = ordered_fold(valid, "account_id", ["seq"], BALANCE, counted=movements)
    balance = cents(F.col("_state"))
    columns = movements.columns
    posted = folded.select(
        *columns,
        F.when(F.col("_result") == 0, 50005).alias("reason_code"),
        balance.alias("balance_after"),
    )
    refused = checked.filter(F.col("reason_code").isNotNull()).select(
        *columns, "reason_code", F.lit(None).cast(MONEY).alias("balance_after")
    )
    outcome = materialise(posted.unionByName(refused), "postings")
    accepted = outcome.filter(F.col("reason_code").isNull())
    change = accepted.groupBy("account_id").agg(F.sum(signed(F.col("direction"), F.col("amount"))).alias("_change"))
    balances = accounts.join(change, "account_id", "left").withColumn(
        "balance", (F.col("balance") + F.coalesce("_change", F.lit(0))).cast(MONEY)
    )
    return {
        "outcome": outcome,
        "accepted": accepted,
        "rejected": outcome.filter(F.col("reason_code").isNotNull()),
        "accounts": balances.select(*accounts.columns),
    }


def ledger_rows(accepted: DataFrame) -> DataFrame:
    """Accepted movements as rows of the cash ledger, the posting order as their key."""
    optional = ["reference_table", "reference_id", "description", "movement_date"]
    have = [F.col(c) for c in optional if c in accepted.columns]
    return accepted.select(
        F.col("seq").alias("movement_id"), "account_id", "direction", "amount", "category", *have
    )


def running_balance(movements: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balance after each movement when all are taken as posted (a ledger read back)."""
    opened = accounts.select("account_id", F.col("balance").alias("_opening"))
    change = signed(F.col("direction"), F.col("amount"))
    parts = chunked(movements.join(opened, "account_id"), "account_id", ["seq"], "ledger", counted=movements)
    run = before(parts, "account_id", ["seq"], {"_earlier": change})
    after = (F.col("_opening") + F.col("_earlier") + change).cast("decimal(38,2)")
    return run.select(*movements.columns, after.alias("running_balance"))
