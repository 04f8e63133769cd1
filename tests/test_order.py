"""Batch results equal serving one document at a time, with keys whole and with keys cut."""

import random
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import acceptance, cash, merge
from tallyworks.operators.acceptance import accept_in_order
from tallyworks.operators.groups import connected
from tallyworks.operators.scan import before, chunked
from tallyworks.sources.tables import assign_keys


def money(rng, top):
    return D(rng.randint(1, top)) / 100


@pytest.mark.parametrize("seed", [1, 2])
def test_cash_in_order(spark, split, seed):
    rng = random.Random(seed)
    # Account 1 holds most movements and is always short; account 3 never is.
    moves = [
        (i, rng.choice([1, 1, 1, 2, 3]), rng.choice(["in", "out", "out"]), money(rng, 5000)) for i in range(200)
    ]
    opening = {1: D("10.00"), 2: D("80.00"), 3: D("100000.00"), 4: D("5.00")}
    accounts = spark.createDataFrame(list(opening.items()), "account_id long, balance decimal(14,2)")
    df = spark.createDataFrame(moves, "seq long, account_id long, direction string, amount decimal(14,2)")
    balance, want = dict(opening), {}
    for seq, account, direction, amount in moves:
        ok = direction == "in" or balance[account] >= amount
        if ok:
            balance[account] += amount if direction == "in" else -amount
        want[seq] = (None if ok else 50005, balance[account])
    posted = cash.post_movements(df, accounts)
    assert {r.seq: (r.reason_code, r.balance_after) for r in posted["outcome"].collect()} == want
    assert {r.account_id: r.balance for r in posted["accounts"].collect()} == balance


def test_average_cost_in_order(spark, split):
    rng = random.Random(3)
    receipts = [(i, rng.choice([1, 1, 1, 2, 5]), D(rng.randint(1, 9000)) / 1000, D(rng.randint(1, 99999)) / 100) for i in range(150)]
    stock = {1: (D("2.500"), D("7.77")), 2: (D(0), D(0)), 3: (D(1), D(1))}
    inventory = spark.createDataFrame([(k, *v) for k, v in stock.items()], "item long, quantity decimal(14,3), avg_cost decimal(14,2)")
    df = spark.createDataFrame(receipts, "seq long, item long, qty decimal(14,3), total_cost decimal(38,5)")
    state, want = dict(stock), {}
    for seq, item, qty, cost in receipts:
        q, a = state.get(item, (D(0), D(0)))
        state[item] = (q + qty, ((q * a + cost) / (q + qty)).quantize(D("0.01"), ROUND_HALF_UP))
        want[seq] = state[item][1]
    got = merge.merge_receipts(inventory, df, "item")
    assert {r.seq: r.avg_cost_after for r in got["receipts"].collect()} == want
    assert {r.item: (r.quantity, r.avg_cost) for r in got["inventory"].collect()} == state
    one = merge.merge_receipt(inventory, df.groupBy("item").agg(F.sum("qty").alias("qty"), F.sum("total_cost").alias("total_cost")), "item")
    assert {r.item: r.quantity for r in one.collect()} == {k: v[0] for k, v in state.items()}


@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_acceptance_in_order(spark, split, block):
    rng = random.Random(block + 1)
    stock = {k: D(rng.randint(0, 60)) for k in range(8)}
    documents = []
    for seq in range(120):
        # Key 0 is in most documents.
        keys = set(rng.sample(range(1, 8), rng.randint(1, 3))) | ({0} if rng.random() < 0.7 else set())
        documents.append((seq, {k: D(rng.randint(1, 8000)) / 1000 for k in keys}, rng.random() < 0.9))
    left, want = dict(stock), {}
    for seq, needs, takes in documents:
        want[seq] = all(left[k] >= n for k, n in needs.items())
        if want[seq] and takes:
            for k, n in needs.items():
                left[k] -= n
    df = spark.createDataFrame(
        [(seq, k, n, stock[k], takes) for seq, needs, takes in documents for k, n in needs.items()],
        "seq long, key long, need decimal(14,3), stock decimal(14,3), takes boolean")
    got = {r.seq: r.accepted for r in accept_in_order(df, block).collect()}
    assert got == want and len(set(want.values())) == 2


def test_alternating_orders_take_few_rounds(spark, monkeypatch):
    """Small orders alternate with orders just too big: a round decides at least its block."""
    rounds = []
    plain = acceptance.materialise
    monkeypatch.setattr(acceptance, "materialise", lambda df, label: rounds.append(label) or plain(df, label))
    needs = [(i, 1, D(2) if i % 2 == 0 else D(99 - i), D(100), True) for i in range(24)]
    df = spark.createDataFrame(needs, "seq long, key long, need decimal(14,3), stock decimal(14,3), takes boolean")
    left, want = D(100), {}
    for seq, _, need, _, _ in needs:
        want[seq] = need <= left
        left -= need if want[seq] else 0
    assert {r.seq: r.accepted for r in accept_in_order(df, 8).collect()} == want
    assert rounds.count("round") <= 4


def test_running_totals_and_keys(spark, split):
    rng = random.Random(5)
    data = [(i, rng.choice([1, 1, 1, 2]), rng.randint(-5, 5)) for i in range(60)]
    df = spark.createDataFrame(data, "seq long, k long, v long")
    total, want = {}, {}
    for seq, k, v in data:
        want[seq] = total.get(k, 0)
        total[k] = want[seq] + v
    run = before(chunked(df, "k", ["seq"]), "k", ["seq"], {"earlier": F.col("v")})
    assert {r.seq: r.earlier for r in run.collect()} == want
    numbered = assign_keys(df, "id", ["v", "seq"], 100)
    assert [r.id for r in numbered.orderBy("v", "seq").collect()] == list(range(101, 161))


def test_running_balance(spark, split):
    moves = spark.createDataFrame([(i, 1, "in" if i % 3 else "out", D(i + 1)) for i in range(20)],
                                  "seq long, account_id long, direction string, amount decimal(14,2)")
    accounts = spark.createDataFrame([(1, D(5))], "account_id long, balance decimal(14,2)")
    got = {r.seq: r.running_balance for r in cash.running_balance(moves, accounts).collect()}
    at, want = D(5), {}
    for i in range(20):
        at += (i + 1) if i % 3 else -(i + 1)
        want[i] = at
    assert got == want


def test_groups_are_served_apart(spark, monkeypatch):
    """Every item has orders of its own that bounds cannot decide: they are served in one round, as many groups."""
    calls = []
    plain = acceptance._served
    monkeypatch.setattr(acceptance, "_served", lambda df: calls.append(df.select("group").distinct().count()) or plain(df))
    needs, left, want = [], {k: D(50) for k in range(24)}, {}
    for seq in range(24 * 16):
        # Small orders alternate with orders just too big; big ones want a second item of their triple too.
        k, turn = seq % 24, seq // 24
        claim = {k: D(1)} if turn % 2 == 0 else {k: left[k] + D(1) / 2, k // 3 * 3 + (k + 1) % 3: D(1)}
        needs += [(seq, key, n, D(50), True) for key, n in claim.items()]
        want[seq] = all(n <= left[key] for key, n in claim.items())
        if want[seq]:
            for key, n in claim.items():
                left[key] -= n
    df = spark.createDataFrame(needs, "seq long, key long, need decimal(14,3), stock decimal(14,3), takes boolean")
    for block in (1_000, 30):
        calls.clear()
        assert {r.seq: r.accepted for r in accept_in_order(df, block).collect()} == want
        assert max(calls) == 8 and len(calls) <= 2 + len(needs) // block
    assert len(set(want.values())) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_numbers(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(130)]
    pairs += [(500, 500), (601, 600), (600, 601)] + [(700, 700 + i) for i in range(1, 60)]
    root = {n: n for pair in pairs for n in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in connected(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    assert got == {n: r for n, r in root.items() if n != r}
