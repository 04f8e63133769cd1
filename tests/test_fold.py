"""Chunk maps and bounds of the ordered fold."""

import random
import time
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

import numpy as np
import pyarrow as pa
import pytest

from tallyworks.operators import cash, fold, merge
from tallyworks.operators.scan import SPLIT_SETTING


@pytest.mark.parametrize("top, high", [(60, 90), (7, 40), (400, 399), (1, 30)])
@pytest.mark.parametrize("seed", range(5))
def test_payment_maps_match_single_folds(seed, top, high):
    rng = random.Random(seed)
    moves = [rng.choice([1, -1, -1]) * rng.randint(1, top) for _ in range(80)]
    for size in (3, 20, 80):
        trace = fold.Payments(0, high)
        for amount in moves[:size]:
            trace.step(0, amount)
        for start in range(high + 1):
            state = start
            for amount in moves[:size]:
                state = cash._pay(0, state, amount)[0]
            assert fold.through(trace.layers(), start) == state


@pytest.mark.parametrize("deposits", [0.0, 0.3, 0.45])
def test_wide_payment_maps_stay_small(deposits):
    """Payments up to 1,000,000.00: the map is far smaller than the number of starts."""
    rng = random.Random(3)
    trace = fold.Payments(0, 99_999_999)
    most = 0
    moves = [rng.choice([1] if rng.random() < deposits else [-1]) * rng.randint(1, 100_000_000) for _ in range(4000)]
    for amount in moves:
        trace.step(0, amount)
        most = max(most, sum(map(len, trace.layers())))
    assert most < 2000
    for start in [0, 99_999_999, *(rng.randrange(100_000_000) for _ in range(20))]:
        state = start
        for amount in moves:
            state = cash._pay(0, state, amount)[0]
        assert fold.through(trace.layers(), start) == state


def after(rows, stock, state):
    for qty, cost in rows:
        state, stock = merge._card_step(stock, state, qty, cost)[0], stock + qty
    return state


@pytest.mark.parametrize("high", [1300, 1_000_000])
def test_average_grids_hold_single_folds(high):
    rng = random.Random(4)
    for stock, top in ((0, 3000), (1_000_000, 3000), (10**13, 10**11)):
        rows, base = [], stock
        for _ in range(60):
            qty = -rng.randint(1, base) if base and rng.random() < 0.3 else rng.randint(1, top)
            rows.append((qty, rng.randint(1, top * 1200) if qty > 0 else 0))
            base += qty
        grid, base = fold.Grid(900, high, False, merge._card_steps), stock
        for qty, cost in rows:
            grid.step(base, qty, cost)
            base += qty
        starts, ends = grid.starts, grid.ends()
        assert len(starts) <= max(fold.GRID, 401) and (starts[0], starts[-1]) == (900, high)
        for _ in range(100):
            low = rng.randint(900, high)
            width = rng.choice([0, 1, 50])
            least, most = fold.image(starts, ends, low, min(low + width, high))
            assert least <= after(rows, stock, low) <= after(rows, stock, min(low + width, high)) <= most
            cell = (high - 900) // (fold.GRID - 1) + 1
            assert most - least <= width + (0 if high - 900 < fold.GRID else cell)


def test_average_step_rounds_half_up():
    assert merge._average(0, 0, 0, 0) == (0, 0)
    # 2 units at 1.01 and 1 unit for 1.005: 3.025 / 3 = 1.00833
    assert merge._average(2000, 101, 1000, 100500)[0] == 101
    # 1 unit at 1.00 and 1 unit for 1.01: 1.005 rounds up
    assert merge._average(1000, 100, 1000, 101000)[0] == 101


def posted_in_order(spark, opening, moves, rows):
    traced = spark.createDataFrame(moves, "seq long, account_id long, direction string, amount decimal(14,2)")
    spark.conf.set(SPLIT_SETTING, str(rows))
    try:
        posted = cash.post_movements(traced, spark.createDataFrame([(1, opening)], "account_id long, balance decimal(14,2)"))
        got = {r.seq: r.balance_after for r in posted["outcome"].collect()}
    finally:
        spark.conf.unset(SPLIT_SETTING)
    balance, want = opening, {}
    for seq, _, direction, amount in moves:
        if direction == "in":
            balance += amount
        elif balance >= amount:
            balance -= amount
        want[seq] = balance
    assert got == want


@pytest.mark.parametrize("kinds", [["in", "out", "out"], ["out"], ["in", "in", "out"]])
def test_large_payments_on_one_account(spark, kinds):
    """An early refusal, then payments up to 1,000,000.00 in many chunks."""
    rng = random.Random(11)
    moves = [(0, 1, "out", D(900_000))]
    moves += [(i, 1, rng.choice(kinds), D(rng.randint(1, 100_000_000)) / 100) for i in range(1, 300)]
    posted_in_order(spark, D(700_000), moves, 40)


@pytest.mark.parametrize("opening", [D(-100), D(-5_000_000)])
def test_a_cut_account_that_opens_below_zero(spark, opening):
    moves = [(0, 1, "out", D(50)), (1, 1, "in", D(10))]
    rng = random.Random(12)
    moves += [(i, 1, rng.choice(["in", "in", "out"]), D(rng.randint(1, 10_000_000)) / 100) for i in range(2, 200)]
    posted_in_order(spark, opening, moves, 2 if opening == -100 else 40)


def test_small_receipts_into_a_large_stock(spark):
    receipts = [(i, 1, D(2000), D(24000)) for i in range(300)]
    stock = [(1, D(1_000_000), D(10))]
    spark.conf.set(SPLIT_SETTING, "25")
    try:
        merged = merge.merge_receipts(
            spark.createDataFrame(stock, "item long, quantity decimal(14,3), avg_cost decimal(14,2)"),
            spark.createDataFrame(receipts, "seq long, item long, qty decimal(14,3), total_cost decimal(38,5)"), "item")
        got = {r.seq: r.avg_cost_after for r in merged["receipts"].collect()}
    finally:
        spark.conf.unset(SPLIT_SETTING)
    (_, quantity, average), want = stock[0], {}
    for seq, _, qty, cost in receipts:
        average = ((quantity * average + cost) / (quantity + qty)).quantize(D("0.01"), ROUND_HALF_UP)
        quantity += qty
        want[seq] = average
    assert got == want


def replay(stock, events):
    """The card by serial replay: (code, quantity, average, cost of an issue) by seq."""
    state, out = dict(stock), {}
    for seq, item, kind, qty, cost in sorted(events):
        quantity, average = state.get(item, (D(0), D(0)))
        if item is None or kind not in ("receipt", "issue") or qty is None or qty <= 0 or kind == "receipt" and (cost is None or cost < 0):
            out[seq] = (547, None, None, None)
        elif kind == "issue" and qty > quantity:
            out[seq] = (52005, None, None, None)
        elif kind == "issue":
            state[item] = (quantity - qty, average)
            out[seq] = (None, quantity - qty, average, qty * average)
        else:
            average = ((quantity * average + cost) / (quantity + qty)).quantize(D("0.01"), ROUND_HALF_UP)
            state[item] = (quantity + qty, average)
            out[seq] = (None, quantity + qty, average, None)
    return out, state


@pytest.mark.parametrize("rows", [None, 7, 60])
@pytest.mark.parametrize("dear", [200, 10_000_000])
def test_stock_card_equals_replay(spark, rows, dear):
    """Receipts and issues mixed, keys cut into chunks, unit costs up to 100,000.00, issues beyond the stock."""
    rng = random.Random(dear)
    stock = {1: (D("1000.000"), D("50.00")), 2: (D(0), D(0)), 4: (D("2.500"), D("7.77"))}
    events = []
    for seq in range(500):
        kind = rng.choice(["receipt", "issue", "issue"])
        qty = D(rng.randint(1, 90_000)) / 1000
        cost = qty * D(rng.randint(1, dear)) / 100 if kind == "receipt" else None
        events.append((seq, rng.choice([1, 1, 1, 2, 3]), kind, qty, cost))
    events += [(900, None, "issue", D(1), None), (901, 1, "gift", D(1), D(1)), (902, 1, "receipt", D(1), None)]
    events += [(903, 2, "receipt", None, D(1)), (904, 2, "issue", D(0), None), (905, None, None, None, None)]
    want, state = replay(stock, events)
    if rows:
        spark.conf.set(SPLIT_SETTING, str(rows))
    try:
        made = merge.stock_card(
            spark.createDataFrame([(k, *v) for k, v in stock.items()], "item long, quantity decimal(14,3), avg_cost decimal(14,2)"),
            spark.createDataFrame(events, "seq long, item long, kind string, qty decimal(14,3), total_cost decimal(38,5)"),
            "item",
        )
        got = {r.seq: (r.reason_code, r.quantity_after, r.avg_cost_after, r.issue_cost) for r in made["card"].collect()}
        left = {r.item: (r.quantity, r.avg_cost) for r in made["inventory"].collect()}
    finally:
        spark.conf.unset(SPLIT_SETTING)
    assert got == want and left == state and {c for c, *_ in want.values()} == {None, 547, 52005}
    empty = spark.createDataFrame([], "seq long, item long, kind string, qty decimal(14,3), total_cost decimal(38,5)")
    assert merge.stock_card(spark.createDataFrame([], "item long, quantity decimal(14,3), avg_cost decimal(14,2)"), empty, "item")["card"].count() == 0


@pytest.mark.parametrize("high", [10, 1_000_000])
def test_wide_average_bounds_cost_little(high):
    """A pass over a million possible averages costs at most a few times the single fold a row."""
    rows = [(2000, 24_000_000 // 1000)] * 3000
    times = []
    for low, top in ((0, 0), (0, high)):
        grid, base, start = fold.Grid(low, top, False, merge._averages), 10**9, time.perf_counter()
        for qty, cost in rows:
            grid.step(base, qty, cost)
            base += qty
        times.append(time.perf_counter() - start)
    assert times[1] < 20 * times[0] + 1


@pytest.mark.parametrize("top, deposits", [(50, 0.5), (50, 0.02), (10**15, 0.3), (3, 0.9)])
def test_runs_and_lanes_equal_single_steps(top, deposits):
    """Blocks of rows of one key and rows of many keys at once, against the step."""
    rng = random.Random(11)
    amounts = [(1 if rng.random() < deposits else -1) * rng.randint(0, top) for _ in range(30_000)]
    for opening in (0, 5 * top, -7):
        states, results = cash.BALANCE.run(0, opening, np.array(amounts))
        balance, want = opening, []
        for amount in amounts:
            balance, passed = cash._pay(0, balance, amount)
            want.append((balance, passed))
        assert list(zip(states.tolist(), results.tolist())) == want
    for step, lanes, inputs in (
        (merge.AVERAGE.step, merge.AVERAGE.lanes, [(rng.randint(0, top), rng.randint(0, top), rng.randint(0, top), rng.randint(0, 10**17)) for _ in range(500)]),
        (merge.STOCK.step, merge.STOCK.lanes, [(rng.randint(0, top), rng.randint(0, top), rng.randint(-top, top) or 1, rng.randint(0, top)) for _ in range(500)]),
    ):
        got = [x.tolist() for x in lanes(*(np.array(c, np.int64) for c in zip(*inputs)))]
        assert list(zip(*got)) == [step(*row) for row in inputs]


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_blocks_carry_their_keys(monkeypatch, block):
    """Keys of very different sizes, cut by blocks and by batches, against row by row."""
    monkeypatch.setattr(fold, "BLOCK", block)
    rng = random.Random(5)
    rows = [(k, -1, 100, k, rng.randint(0, 9), rng.randint(-50, 30)) for k in range(40) for _ in range(rng.choice([1, 2, 9, 60]))]
    want = []
    for i, (k, _, base, state, delta, amount) in enumerate(rows):
        base, state = (base, state) if not i or rows[i - 1][0] != k else want[-1][1:]
        after, result = cash._pay(base, state, amount)
        want.append((result, base + delta, after))
    names = ["k", "_chunk", "_base", "_open", "_delta", "_signed"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 25])], names=names) for i in range(0, len(rows), 25)]
    stream = fold._stream(names, fold._pair(cash.BALANCE), ["r", "b", "s"], with_base=True)
    assert [tuple(r.values()) for batch in stream(iter(batches)) for r in batch.select(["r", "b", "s"]).to_pylist()] == want


def test_stock_card_computes_its_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "seq long, item long, kind string, qty decimal(14,3), total_cost decimal(38,5)"
    rows = [(i, i % 20, "issue" if i % 3 else "receipt", D(1 + i % 4), None if i % 3 else D(9)) for i in range(300)]
    events = spark.createDataFrame(rows, schema).mapInArrow(note, schema)
    inventory = spark.createDataFrame([], "item long, quantity decimal(14,3), avg_cost decimal(14,2)")
    made = merge.stock_card(inventory, events, "item")
    assert made["card"].count() == 300 and made["inventory"].count() == 20
    assert seen.value == 300
