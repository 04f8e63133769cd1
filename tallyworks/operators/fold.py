"""Order-dependent folds per key: each row's result depends on the state the earlier rows left.

Rows are folded as a stream of sorted rows, so a task holds one Arrow batch at a time. Keys
beyond the split limit are cut into chunks as for running totals (``tallyworks.operators.scan``).
Every chunk of such a key is traced, all at the same time, from starts between two proven bounds, and
the chunks' maps are linked in order, which gives every chunk its exact start; then the rows are folded.

Most keys have few rows: a task steps all keys of a block of rows at once (``Fold.lanes``), row by row of a
key only where too few keys are left.

* Where runs of starts move together (payments), the map of all starts is traced once, as pieces.
* Where a larger start never gives a smaller end, nor raises it by more than the start (averages), a
  grid of starts is traced. Linked, it leaves every chunk a bracket for its start, about as wide as a cell of
  the grid, and the next pass traces a grid inside the bracket: two or three passes at any width.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.operators.scan import Parts, chunked
from tallyworks.session import materialise


@dataclass(frozen=True)
class Fold:
    """A fold over whole-number columns.

    ``step(base, state, *inputs)`` returns (new state, result). ``base`` is the opening base
    plus the ``delta`` of the earlier rows, a plain running sum that needs no guessing.
    ``bounds(rows, key, order)`` returns a table of key, ``_chunk``, ``_start_base`` (the base at
    the start of the chunk), ``_opening`` (state before the first chunk), ``_low`` and ``_high``
    (between them lies the state at the start). ``trace(low, high)`` returns an object that
    takes the same steps from all these starts: ``step(base, *inputs)``, then ``layers()``. Folds without it
    have ``many(base, states, *inputs)``, the step from an array of states, and their bounds a column ``_every``,
    true for chunks whose map is not monotone: they are traced from every start.
    ``lanes`` is ``step`` for arrays, one element a key; ``run(base, state, *inputs)`` folds arrays of consecutive rows
    of one key whose ``delta`` is 0 and returns their states and results.
    """

    step: Callable
    bounds: Callable
    inputs: tuple[str, ...]
    delta: str
    trace: Callable | None = None
    many: Callable | None = None
    lanes: Callable | None = None
    run: Callable | None = None


@dataclass(frozen=True)
class Piece:
    """Starts first..last lead to ``end``, or, with slope 1, to ends ascending from it."""

    first: int
    last: int
    end: int
    slope: int

    def at(self, start: int) -> int:
        return self.end + self.slope * (start - self.first)


def through(layers: list[list[Piece]], state: int) -> int:
    """The end of ``state`` after all layers; the pieces of a layer ascend and do not overlap."""
    for pieces in layers:
        i = bisect_right(pieces, state, key=lambda p: p.first) - 1
        if i < 0 or state > pieces[i].last:
            raise ValueError("a state lies outside its bounds")
        state = pieces[i].at(state)
    return state


class Payments:
    """All balances low..high at once, when a row adds an amount or, if it can be paid, takes it.

    Balances are runs of neighbours (low, high, low at the start of the layer), ascending and
    apart, all to be read with one shared offset. A payment that all or none can make costs one
    step. Otherwise the runs are split at the amount; when balances of different starts meet, the
    layer ends and they go on as one. Layers before a single common balance are forgotten.
    """

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.offset = 0
        self.runs = [(low, high, low)]
        self.done: list[list[Piece]] = []

    def step(self, _base: int, amount: int) -> None:
        least = -amount - self.offset
        if amount >= 0 or self.runs[0][0] >= least:
            self.offset += amount
        elif self.runs[-1][1] >= least:
            self._split(least, amount)

    def _split(self, least: int, amount: int) -> None:
        after = []
        for low, high, first in self.runs:
            if low < least:
                after.append((low, min(high, least - 1), first))
            if high >= least:
                begin = max(low, least)
                after.append((begin + amount, high + amount, first + begin - low))
        after.sort()
        joined = [after[0]]
        meet = False
        for low, high, first in after[1:]:
            a, b, start = joined[-1]
            meet |= low <= b
            if low == b + 1 and first == start + low - a:
                joined[-1] = (a, high, start)
            else:
                joined.append((low, high, first))
        self.runs = joined
        if meet:
            self._end_layer()

    def _end_layer(self) -> None:
        self.done.append(self._pieces())
        merged: list[list[int]] = []
        for low, high, _ in self.runs:
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        self.runs = [(a + self.offset, b + self.offset, a + self.offset) for a, b in merged]
        self.offset = 0
        if len(merged) == 1 and merged[0][0] == merged[0][1]:
            self.done = [[Piece(self.low, self.high, self.runs[0][0], 0)]]

    def _pieces(self) -> list[Piece]:
        pieces = [Piece(first, first + high - low, low + self.offset, 1) for low, high, first in self.runs]
        return sorted(pieces, key=lambda p: p.first)

    def layers(self) -> list[list[Piece]]:
        return [*self.done, self._pieces()]


#: Starts that one pass traces between the bounds of a chunk.
GRID = 256


class Grid:
    """States after the same steps from a grid of starts; equal neighbours go on as one."""

    def __init__(self, low: int, high: int, every: bool, many: Callable):
        self.many = many
        if every or high - low < GRID:
            self.starts = np.arange(low, high + 1, dtype=np.int64)
        else:
            self.starts = np.array([low + (high - low) * i // (GRID - 1) for i in range(GRID)], np.int64)
        self.now = self.starts
        self.place = np.arange(len(self.now))

    def step(self, base: int, *inputs: int) -> None:
        now = self.many(base, self.now, *inputs)
        if len(now) > 1:
            keep = now[1:] != now[:-1]
            if not keep.all():
                self.place = np.concatenate(([0], np.cumsum(keep)))[self.place]
                now = now[np.concatenate(([True], keep))]
        self.now = now

    def ends(self) -> np.ndarray:
        return self.now[self.place]


def image(starts: np.ndarray, ends: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Bounds of the ends of all starts low..high, from the ends of a grid of starts that spans them."""
    if len(starts) == starts[-1] - starts[0] + 1:
        part = ends[low - starts[0] : high - starts[0] + 1]
        return int(part.min()), int(part.max())
    # From one start to the next the end stays or rises by one.
    i = int(np.searchsorted(starts, low, side="right")) - 1
    least = int(ends[i])
    if starts[i] < low:
        least = max(least, int(ends[i + 1] - (starts[i + 1] - low)))
    j = int(np.searchsorted(starts, high))
    most = int(ends[j])
    if starts[j] > high:
        most = min(most, int(ends[j - 1] + (high - starts[j - 1])))
    return least, most


def ordered_fold(
    rows: DataFrame, key: str, order: list[str], fold: Fold, counted: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``_result`` and ``_state`` (after the row) for every row.

    ``rows`` holds ``_base`` and ``_open`` (opening base and state of its key, bigint) and the
    fold's bigint input columns; (key, order) must be unique. ``counted`` is as in ``chunked``.
    """
    parts = chunked(rows, key, order, "fold", counted)
    ready = parts.rows
    names = ready.columns
    if parts.split:
        known = (_refined_starts if fold.many else _chunk_starts)(parts, key, order, fold)
        ready = (
            ready.join(known, [key, "_chunk"], "left")
            .withColumn("_base", F.coalesce("_start_base", "_base"))
            .withColumn("_open", F.coalesce("_start", "_open"))
            .select(*names)
        )
    groups = [key, "_chunk"] if parts.split else [key]
    added = [T.StructField("_result", T.LongType()), T.StructField("_state", T.LongType())]
    sorted_rows = ready.repartition(*groups).sortWithinPartitions(*groups, *order)
    names = [key, "_chunk", "_base", "_open", fold.delta, *fold.inputs]
    out = sorted_rows.mapInArrow(_stream(names, _pair(fold), ["_result", "_state"]), T.StructType([*ready.schema.fields, *added]))
    return out.drop("_chunk", "_base", "_open")


def pair_fold(rows: DataFrame, key: str, order: list[str], pair: Pair, inputs: list[str], added: list[str]) -> DataFrame:
    """``rows``, whose keys have few rows each, with the result and both states after every row as the three ``added``
    columns; ``_base`` and ``_open`` open the states of a key and are dropped."""
    ready = rows.withColumn("_chunk", F.lit(-1).cast("int"))
    schema = T.StructType([*ready.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])
    names = [key, "_chunk", "_base", "_open", *inputs]
    stream = _stream(names, pair, added, with_base=True)
    out = ready.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)
    return out.drop("_chunk", "_base", "_open")


def _chunk_starts(parts: Parts, key: str, order: list[str], fold: Fold) -> DataFrame:
    """Exact ``_start_base`` and ``_start`` (state) of every chunk of the cut keys.

    Bounds and maps are tables with one row per (key, chunk); the maps of a key are linked by one
    task, which reads them as a stream. Nothing goes through the driver.
    """
    shared = parts.cut()
    bounds = materialise(fold.bounds(shared, key, order), "fold-bounds")
    layers = "layers array<array<struct<first:bigint,last:bigint,end:bigint,slope:int>>>"
    maps = (
        shared.select(key, "_chunk", *order, *dict.fromkeys([fold.delta, *fold.inputs]))
        .join(bounds, [key, "_chunk"])
        .repartition(key, "_chunk")
        .sortWithinPartitions(key, "_chunk", *order)
        .mapInArrow(_trace_chunks(key, fold), f"{key} bigint, _chunk int, _start_base bigint, _opening bigint, {layers}")
    )
    linked = (
        materialise(maps, "fold-maps")
        .repartition(key)
        .sortWithinPartitions(key, "_chunk")
        .mapInArrow(_link(key), f"{key} bigint, _chunk int, _start_base bigint, _start bigint")
    )
    return materialise(linked, "fold-starts")


def _refined_starts(parts: Parts, key: str, order: list[str], fold: Fold) -> DataFrame:
    """As ``_chunk_starts``, by brackets that every pass narrows until they hold one start each."""
    shared = parts.cut().select(key, "_chunk", *order, *dict.fromkeys([fold.delta, *fold.inputs]))
    brackets = materialise(fold.bounds(parts.cut(), key, order), "fold-bounds")
    while (brackets.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0) > 0:
        maps = (
            shared.join(brackets, [key, "_chunk"])
            .repartition(key, "_chunk")
            .sortWithinPartitions(key, "_chunk", *order)
            .mapInArrow(_trace_grids(key, fold), f"{_BRACKETS.format(key)}, starts array<bigint>, ends array<bigint>")
        )
        linked = materialise(maps, "fold-maps").repartition(key).sortWithinPartitions(key, "_chunk")
        brackets = materialise(linked.mapInArrow(_narrow(key), _BRACKETS.format(key)), "fold-brackets")
    return brackets.select(key, "_chunk", "_start_base", F.col("_low").alias("_start"))


_BRACKETS = "{} bigint, _chunk int, _start_base bigint, _opening bigint, _low bigint, _high bigint, _every boolean"


def _bracket_names(key: str) -> list[str]:
    return [key, "_chunk", "_start_base", "_opening", "_low", "_high", "_every"]


def _trace_grids(key: str, fold: Fold) -> Callable:
    """Task function: ends of a grid of starts of each chunk."""
    names = _bracket_names(key)
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), *[pa.list_(pa.int64())] * 2]
    out = pa.schema(list(zip([*names, "starts", "ends"], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, grid = None, 0, None

        def done() -> pa.RecordBatch:
            values = [*at, grid.starts.tolist(), grid.ends().tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], schema=out)

        for batch in batches:
            for *chunk, delta, args in zip(*_columns_of(batch, [*names, fold.delta]), _columns(batch, list(fold.inputs))):
                if at is None or chunk[:2] != at[:2]:
                    if at is not None:
                        yield done()
                    at, base, grid = chunk, chunk[2], Grid(*chunk[4:7], fold.many)
                grid.step(base, *args)
                base += delta
        if at is not None:
            yield done()

    return run


def _narrow(key: str) -> Callable:
    """Task function: brackets of the starts of every key's chunks, from their grids in order."""
    names = _bracket_names(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, high = None, 0, 0
        for batch in batches:
            lows, highs = [], []
            for k, opening, least, most, starts, ends in _columns(batch, [key, "_opening", "_low", "_high", "starts", "ends"]):
                if k != at:
                    at, low, high = k, opening, opening
                low, high = max(low, least), min(high, most)
                if low > high:
                    raise ValueError("a state lies outside its bounds")
                lows.append(low)
                highs.append(high)
                low, high = image(np.array(starts, np.int64), np.array(ends, np.int64), low, high)
            columns = [*batch.columns[:4], pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), batch.columns[6]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _columns_of(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*_columns_of(batch, names))


@dataclass(frozen=True)
class Pair:
    """A fold of two states: ``step(a, b, *inputs)`` returns (new a, new b, result), ``lanes`` the same for arrays;
    ``run(a, b, *inputs)`` takes consecutive rows of one key and returns arrays of all three, or None."""

    step: Callable
    lanes: Callable | None = None
    run: Callable | None = None


def _pair(fold: Fold) -> Pair:
    """``fold`` with the base as its first state, moved by the first input."""

    def step(base, state, delta, *inputs):
        state, result = fold.step(base, state, *inputs)
        return base + delta, state, result

    def lanes(base, state, delta, *inputs):
        state, result = fold.lanes(base, state, *inputs)
        return base + delta, state, result

    def run(base, state, delta, *inputs):
        if delta.any():
            return None
        states, results = fold.run(base, state, *inputs)
        return np.full(len(states), base, np.int64), states, results

    return Pair(step, fold.lanes and lanes, fold.run and run)


#: Rows that a task folds at once; below LEAST_LANES keys it goes row by row.
BLOCK = 1 << 18
LEAST_LANES = 16


def _stream(names: list[str], pair: Pair, added: list[str], with_base: bool = False) -> Callable:
    """Task function: fold the sorted rows block by block, carrying the states from block to block. ``names``: key,
    chunk, opening states and inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for block in _blocks_of(batches):
            columns = [_whole_numbers(block, n) for n in names[2:]]
            keys = [pa.chunked_array([b.column(b.schema.get_field_index(n)) for b in block]) for n in names[:2]]
            first = np.zeros(len(columns[0]), bool)
            first[0] = True
            for k in keys:
                empty = k.is_null().to_numpy()
                values = k.fill_null(0).to_numpy()
                first[1:] |= (values[1:] != values[:-1]) | (empty[1:] != empty[:-1])
            begins = np.flatnonzero(first)
            sizes = np.diff(begins, append=len(first))
            a, b = columns[0][begins], columns[1][begins]
            at = [k[0].as_py() for k in keys]
            if carried is not None and carried[0] == at:
                a[0], b[0] = carried[1:]
            results, bases, states = _fold_block(pair, begins, sizes, a, b, columns[2:])
            carried = [k[-1].as_py() for k in keys], int(bases[-1]), int(states[-1])
            more = [results, bases, states] if with_base else [results, states]
            low = 0
            for batch in block:
                high = low + batch.num_rows
                new = [pa.array(x[low:high], pa.int64()) for x in more]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])
                low = high

    return run


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    block, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            block.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK:
            yield block
            block, rows = [], 0
    if block:
        yield block


def _whole_numbers(block: list[pa.RecordBatch], name: str) -> np.ndarray:
    parts = [b.column(b.schema.get_field_index(name)) for b in block]
    if any(p.null_count for p in parts):
        raise TypeError(f"a row to fold has no {name}")
    return np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)


def _fold_block(pair: Pair, begins, sizes, a, b, inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Results and both states after each row; groups of rows begin at ``begins`` with the states ``a`` and ``b``."""
    total = int(sizes.sum())
    results, left, right = (np.empty(total, np.int64) for _ in range(3))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, a, b = begins[order], sizes[order], a[order], b[order]
    done = 0
    if pair.lanes:
        active = len(sizes)
        while active >= LEAST_LANES:
            at = begins[:active] + done
            a[:active], b[:active], result = pair.lanes(a[:active], b[:active], *(x[at] for x in inputs))
            results[at], left[at], right[at] = result, a[:active], b[:active]
            done += 1
            active = int(np.searchsorted(-sizes, -done))  # sizes descend: those beyond ``done``
    for i in np.flatnonzero(sizes > done):
        low, high = int(begins[i]) + done, int(begins[i] + sizes[i])
        part = [x[low:high] for x in inputs]
        whole = pair.run(int(a[i]), int(b[i]), *part) if pair.run else None
        if whole is not None:
            left[low:high], right[low:high], results[low:high] = whole
            continue
        x, y, found = int(a[i]), int(b[i]), []
        for args in zip(*(p.tolist() for p in part)):
            x, y, result = pair.step(x, y, *args)
            found.append((result, x, y))
        results[low:high], left[low:high], right[low:high] = np.array(found, np.int64).T
    return results, left, right


def _trace_chunks(key: str, fold: Fold) -> Callable:
    """Task function: map of each chunk from the starts ``_low``..``_high`` to end states."""
    names = [key, "_chunk", "_start_base", "_opening", "_low", "_high", fold.delta, *fold.inputs]
    piece = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("end", pa.int64()), ("slope", pa.int32())])
    out = pa.schema(
        [(key, pa.int64()), ("_chunk", pa.int32()), ("_start_base", pa.int64()), ("_opening", pa.int64())]
        + [("layers", pa.list_(pa.list_(piece)))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, trace = None, 0, None

        def done() -> pa.RecordBatch:
            layers = [[vars(p) for p in pieces] for pieces in trace.layers()]
            return pa.RecordBatch.from_pylist([dict(zip(out.names, [*at, layers]))], schema=out)

        for batch in batches:
            for k, chunk, base0, opening, low, high, delta, *args in _columns(batch, names):
                if at is None or (k, chunk) != at[:2]:
                    if at is not None:
                        yield done()
                    at, base, trace = (k, chunk, base0, opening), base0, fold.trace(low, high)
                trace.step(base, *args)
                base += delta
        if at is not None:
            yield done()

    return run


def _link(key: str) -> Callable:
    """Task function: exact starts of the chunks of every key, from their maps in order."""
    names = [key, "_chunk", "_start_base", "_opening", "layers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, 0
        for batch in batches:
            starts = []
            for k, _, _, opening, layers in _columns(batch, names):
                if k != at:
                    at, state = k, opening
                starts.append(state)
                state = through([[Piece(**p) for p in pieces] for pieces in layers], state)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(starts, pa.int64())], names=[*names[:3], "_start"]
            )

    return run
