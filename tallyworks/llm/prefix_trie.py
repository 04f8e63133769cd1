"""Trie of conversation prefixes, by truncation peeling.

A node is a distinct sequence of first turns. Peeling descends from the greatest depth: the nodes of
depth ``d`` are the survivors that still have ``d`` turns together with the conversations that end there;
a node is complete then, gives out its row, loses its last turn and is regrouped with its siblings one
turn higher. So nodes are found and aggregated in the same pass.

The pass runs on blocks of conversations in the order of their paths (a digest for each turn), so that
all nodes but those on the first and the last path of a block lie wholly inside. The open nodes of
these two spines carry what the block knows of them to the next level, where the spines of many blocks are
peeled in the same way, until one block is left and closes the root. A level shrinks at least fourfold,
whatever the depth of a conversation and however many share a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyworks.session import materialise

#: Bytes of a turn in a path: 16 of its digest, 4 of the size of its text.
STEP = 20

#: A block is cut when it has this many bytes of paths, and at least so many rows.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 16

_SPINE = ("s_depth", "s_convs", "s_conv", "s_children", "s_leaves", "s_saved")
_FIELDS = [
    ("kind", pa.int32()),  # 0: node, 1: spine, 2: ids of conversations that end at an open node
    ("key", pa.binary()),  # digest of an open node's path; for a spine the path itself
    ("parent_key", pa.binary()),  # of a node whose parent was still open
    ("conv_id", pa.int64()),
    ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()),
    ("n_children", pa.int64()),
    ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()),
    ("ends", pa.string()),  # hash of the ids, or the ids themselves (kind 2)
    *((name, pa.list_(pa.int64())) for name in _SPINE),
]
_SCHEMA_ARROW = pa.schema(_FIELDS)
_SCHEMA = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, " + ", ".join(f"{n} array<long>" for n in _SPINE)
)
_NO_CONV = np.iinfo(np.int64).max
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def step(role: Column, text: Column) -> Column:
    """Digest of a turn and the size of its text in UTF-8."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    size = F.octet_length(text)
    return F.concat(F.unhex(F.md5(whole)), F.unhex(F.lpad(F.hex(size), 8, "0")))


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``path`` (steps one after the other) of every conversation of ``turns`` (conv_id, turn,
    role, text). Order: turn (null first), then role and text. Turns without a conv_id take no part.

    Long texts are only sorted; what is gathered is 20 bytes a turn, so a conversation may have up
    to 100 million turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    named = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role, text)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = named.select("conv_id", F.row_number().over(order).alias("place"), step(F.col("role"), F.col("text")).alias("step"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "step"))).alias("steps"))
    # concat of an array of binaries, as Spark's array_join is for strings only
    return gathered.select("conv_id", F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["step"])), "")).alias("path"))


def rebuild(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Paths where a conversation's first turns come from the first of its family (conv_id - conv_id % family).

    The first ``h`` turns are those of that conversation (all if it has fewer, none if it does not exist), the
    others the conversation's own after its first ``h``; h is crc32 of the decimal id modulo ``modulus``. The
    remainder of a negative id is negative or zero, as in SQL.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    own = conversations.select("conv_id", "path", first.alias("first"), (h * STEP).alias("taken"))
    heads = conversations.select(F.col("conv_id").alias("first"), F.expr(f"substring(path, 1, {STEP * (modulus - 1)})").alias("head"))
    begin = F.expr("substring(coalesce(head, x''), 1, taken)")
    rest = F.expr("substring(path, taken + 1, octet_length(path))")
    return own.join(heads, "first", "left").select("conv_id", F.concat(begin, rest).alias("path"))


def _common(a: bytes, b: bytes) -> int:
    """Steps that two paths have in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // STEP
    low, high = 0, most // STEP  # a[:low] is common, a[:high + 1] is not
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


class Block:
    """Conversations or spines in the order of their paths."""

    def __init__(self, rows: list[bytes], given: np.ndarray, conv_ids: np.ndarray | None, closed: bool):
        """``given``: rows (row, depth, convs, smallest conv, children, leaves, saved) of what is known to end
        or lie below a row's prefix; ``conv_ids`` of the rows where they are conversations; ``closed`` if no other
        block has part of the nodes."""
        self.paths = rows
        self.given = given[np.argsort(-given[:, 1], kind="stable")]
        self.conv_ids, self.closed = conv_ids, closed
        self.length = np.array([len(p) // STEP for p in rows], np.int64)
        self.common = np.array([-1, *map(_common, rows, rows[1:])], np.int64)
        flat = np.frombuffer(b"".join(rows), np.uint8)
        self.begin = np.cumsum(self.length) - self.length
        self.sizes = np.ascontiguousarray(flat.reshape(-1, STEP)[:, 16:]).view(">u4").ravel().astype(np.int64)
        self.nodes: list[np.ndarray] = []  # depth, conv, parent's conv, convs, children, leaves, saved, first row, parent is open
        self.spines: dict[int, list[tuple]] = {0: [], len(rows) - 1: []}
        self.ends: dict[tuple[int, int], str] = {}  # (first row, depth): ids that end there

    def peel(self) -> None:
        by_length = np.argsort(-self.length, kind="stable")
        depths = -np.arange(-1, int(self.length.max()) + 1)  # place 0 is the end of depth 0
        ended_at = np.searchsorted(-self.length[by_length], depths)
        given_at = np.searchsorted(-self.given[:, 1], depths)
        first, state = np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
        waiting = np.zeros((0, 9), np.int64)  # complete children of the depth below, without their parent
        for depth in range(int(self.length.max()), -1, -1):
            ended = np.sort(by_length[ended_at[depth + 1] : ended_at[depth]])
            first, state = self._merge(first, state, ended)
            given = self.given[given_at[depth + 1] : given_at[depth]]
            at = np.searchsorted(first, given[:, 0], side="right") - 1
            for column in (0, 2, 3, 4):
                np.add.at(state[:, column], at, given[:, column + 2])
            np.minimum.at(state[:, 1], at, given[:, 3])
            starts = np.flatnonzero(self.common[first] < depth)
            grouped = np.add.reduceat(state, starts, axis=0)
            grouped[:, 1] = np.minimum.reduceat(state[:, 1], starts)
            if len(waiting):
                parent = np.searchsorted(first[starts], waiting[:, 7], side="right") - 1
                waiting[:, 2] = grouped[parent, 1]
                waiting[:, 8] = self._open(first, starts, depth)[parent]
                self.nodes.append(waiting)
            if self.conv_ids is not None and len(ended):
                self._note_ends(first[starts], ended, depth)
            first, state, waiting = self._close(first, starts, grouped, depth)
        if len(waiting):
            waiting[:, 2] = -1
            self.nodes.append(waiting)

    def _merge(self, first, state, ended):
        if not len(ended):
            return first, state
        fresh = np.zeros((len(ended), 5), np.int64)
        fresh[:, 1] = _NO_CONV
        first = np.concatenate((first, ended))
        order = np.argsort(first, kind="stable")
        return first[order], np.concatenate((state, fresh))[order]

    def _open(self, first, starts, depth) -> np.ndarray:
        found = np.zeros(len(starts), bool)
        if not self.closed:
            found[0] |= first[0] == 0
            found[-1] |= self.length[-1] >= depth
        return found

    def _close(self, first, starts, grouped, depth):
        """Nodes of a depth: complete ones wait for their parent, open ones go to the spines. What is left is
        the same groups one turn shorter."""
        head, opened = first[starts], self._open(first, starts, depth)
        convs, conv, children, leaves, saved = grouped.T
        leaves = np.where(children == 0, 1, leaves)
        size = self.sizes[self.begin[head] + depth - 1] if depth else np.zeros(len(head), np.int64)
        whole = saved + (convs - 1) * size
        zero = np.zeros_like(head)
        node = np.column_stack((zero + depth, conv, zero, convs, children, leaves, whole, head, zero))
        for i in np.flatnonzero(opened):
            row = 0 if head[i] == 0 else len(self.paths) - 1
            if convs[i]:
                self.spines[row].append((depth, *grouped[i].tolist()))
        left = np.column_stack((convs, conv, np.ones_like(head), leaves, whole))
        left[opened] = (0, _NO_CONV, 0, 0, 0)
        return head, left, node[~opened]

    def _note_ends(self, head, ended, depth) -> None:
        at = np.searchsorted(head, ended, side="right") - 1
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(ended)]
        for low, high in zip(cuts, cuts[1:]):
            ids = self.conv_ids[ended[low:high]].tolist()
            self.ends[int(head[at[low]]), depth] = ",".join(map(str, ids))


def _digest(path: bytes) -> bytes:
    return hashlib.md5(path).digest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in _FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=_SCHEMA_ARROW)


def _results(block: Block, keyed: bool):
    """Rows of a peeled block, in batches. ``keyed``: nodes of a later level say which open node they were."""
    none = (None,) * len(_SPINE)
    rows: list[tuple] = []
    for nodes in block.nodes:
        for depth, conv, parent, convs, children, leaves, saved, head, parent_open in nodes.tolist():
            path = block.paths[head]
            key = _digest(path[: depth * STEP]) if keyed else None
            parent_key = _digest(path[: (depth - 1) * STEP]) if parent_open else None
            ids = block.ends.get((head, depth))
            ends = hashlib.sha256(ids.encode()).hexdigest() if ids else None if keyed else _EMPTY_HASH
            above = None if parent_open or not depth else parent
            rows.append((0, key, parent_key, conv, depth, above, convs, children, leaves, saved, ends, *none))
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    if not block.closed:
        for row, spine in block.spines.items():
            lists = [list(c) for c in zip(*spine)] or [[] for _ in _SPINE]
            if spine or row == 0:
                rows.append((1, block.paths[row], *(None,) * 9, *lists))
            for depth, *_ in spine:
                head = _head(block, row, depth)
                if ids := block.ends.get((head, depth)):
                    smallest = int(ids.split(",", 1)[0])
                    rows.append((2, _digest(block.paths[row][: depth * STEP]), None, smallest, *(None,) * 6, ids, *none))
    if rows:
        yield _batch(rows)


def _head(block: Block, row: int, depth: int) -> int:
    """First row of the block's node at this depth of the row's path."""
    while row > 0 and block.common[row] >= depth:
        row -= 1
    return row


def _conversations(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([conv for _, conv in rows], np.int64)
    depth = np.array([len(path) // STEP for path, _ in rows], np.int64)
    one, zero = np.ones_like(ids), np.zeros_like(ids)
    return ids, np.column_stack((np.arange(len(ids)), depth, one, ids, zero, zero, zero))


def _spines(rows: list[tuple]) -> np.ndarray:
    parts = [np.column_stack((np.full(len(lists[0]), i), *lists)) for i, (_, *lists) in enumerate(rows) if len(lists[0])]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, 7), np.int64)


def _peel_level(sorted_rows: DataFrame, raw: bool, closed: bool, block_bytes: int) -> DataFrame:
    def run(batches):
        rows: list[tuple] = []
        held = 0

        def done():
            ids, given = _conversations(rows) if raw else (None, _spines(rows))
            block = Block([r[0] for r in rows], given, ids, closed)
            block.peel()
            yield from _results(block, keyed=not raw)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[0]) + (STEP if raw else 48 * len(row[1]) + STEP)
                if not closed and held >= block_bytes and len(rows) >= BLOCK_ROWS:
                    yield from done()
                    rows, held = [], 0
        if rows:
            yield from done()

    return sorted_rows.mapInArrow(run, _SCHEMA)


def peel(conversations: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie of ``conversations`` (conv_id, path): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, the
    bytes of a node's last text once for every member but one) and ``ends_sha256`` (of the ids that end there).
    No conversation, no node."""
    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations.repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    level = materialise(_peel_level(ordered.select("path", "conv_id"), True, False, block_bytes), "trie")
    pieces = level.filter("kind = 2").select("key", "conv_id", "ends")
    levels = [level]
    while True:
        spines = level.filter("kind = 1").select(F.col("key").alias("path"), *_SPINE)
        rows, size = spines.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path") + 48 * F.size("s_depth")), F.lit(0))).first()
        if not rows:
            break
        parts = max(1, min(-(-int(size) // (4 * block_bytes)), rows // (4 * BLOCK_ROWS)))
        closed = parts == 1
        spread = spines.repartition(1) if closed else spines.repartitionByRange(parts, "path")
        level = materialise(_peel_level(spread.sortWithinPartitions("path"), False, closed, block_bytes), "trie")
        levels.append(level)
        if closed:
            break
    return _named(levels, pieces)


def _hashed(pieces: DataFrame) -> DataFrame:
    """``key`` and hash of the ids of every open node; a node's pieces are read in order, one at a time."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for this, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if this == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = this, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], names=["key", "hash"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "hash"])

    ordered = pieces.repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.select("key", "ends").mapInArrow(run, "key binary, hash string")


def _named(levels: list[DataFrame], pieces: DataFrame) -> DataFrame:
    columns = ("key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    own, *later = (level.filter("kind = 0").select(*columns) for level in levels)
    result = own
    if later:
        opened = later[0]
        for more in later[1:]:
            opened = opened.unionByName(more)
        above = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
        hashed = opened.join(_hashed(pieces), "key", "left").withColumn("ends", F.coalesce("hash", F.lit(_EMPTY_HASH)))
        every = own.unionByName(hashed.select(*columns))
        # The children of the root are many and their parent is known: keep them out of the join.
        root = opened.filter("depth = 0").select(F.col("conv_id").alias("root"))
        joined = every.join(above, (every.parent_key == above.parent_key) & (every.depth > 1), "left").drop(above.parent_key)
        known = F.coalesce("parent_conv_id", "above", F.when(F.col("depth") == 1, F.col("root")))
        result = joined.crossJoin(F.broadcast(root)).withColumn("parent_conv_id", known)  # one row
    return result.select(*columns[2:-1], F.col("ends").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations of ``turns`` (conv_id, turn, role, text; other columns
    are ignored), as ``peel`` gives them.

    Null roles and texts are empty, a null turn comes first, equal turns go by role and text, and
    repeated rows are turns of their own. Rows without a conv_id take no part. A conversation without
    turns after rebuilding is a member of the root only. An empty table has no nodes.
    """
    return peel(materialise(rebuild(materialise(paths(turns), "paths")), "rebuilt"), block_bytes)
