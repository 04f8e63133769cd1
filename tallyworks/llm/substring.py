"""Removal of word sequences that stand in an earlier document.

A window is ``WINDOW`` words in a row. Its minimiser is the smallest hash of ``MINIMISER`` words in
a row inside it. Consecutive windows with the same minimiser (a super-k-mer) travel as one string of
words to the bucket of the minimiser. Strings that a task sends to one bucket are compressed together,
as neighbouring strings share most of their words. In the bucket, windows are sorted by a hash, equal
ones are compared word for word, and every occurrence outside the document with the smallest id is
reported.

Hot groups: equal super-k-mers of one slice of input are sent once, for the smallest id; the others
are known to be repeated. If a part of a bucket (a range of minimisers) still exceeds ``GROUP_BYTES``, its windows go on
one by one, each to the partition of its own hash, where they are read as a stream in order of
document ids and only the first document of a window is held.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyworks.llm.texts import slices, utf8

WINDOW = 13
MINIMISER = 3

#: Words of a bucket in bytes, about; sets the number of buckets.
BUCKET_BYTES = 24 << 20
#: Words of a bucket at which large parts are looked for.
BUCKET_MOST = 48 << 20
#: Words compared at a time, and the most for one part of a bucket before its windows are sent on.
BLOCK_BYTES = 2 << 20
GROUP_BYTES = 6 << 20
#: Words that a task gathers before it sends them.
SEND_BYTES = 64 << 20
#: Windows of one packed string at most.
MOST_WINDOWS = 256
#: Bytes of packed strings for a byte of text, about; only used to choose a number of buckets.
EXPANSION = 3

_NO_ID = (1 << 63) - 1

# Compressed strings of words for a bucket.
_SENT = "route long, sent binary"
_SENT_ARROW = pa.schema([("route", pa.int64()), ("sent", pa.binary())])

# A single window, or, with null words, a range of ``extra`` repeated windows. ``place`` is the text's
# key (upper half) and the number of its first word (lower half).
_ROW = "route long, doc long, place long, extra long, words binary"
_ROW_ARROW = pa.schema(
    [("route", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("extra", pa.int64()), ("words", pa.binary())]
)

_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _minimisers(hashes: np.ndarray, window: int, size: int) -> np.ndarray:
    """Smallest hash of ``size`` words in each window of ``window`` words."""
    mers = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        mers = mers * np.uint64(_BASE) + hashes[i : len(hashes) - size + 1 + i]
    low, span, need = _mix(mers), 1, window - size + 1
    while 2 * span <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (need - span)], low[need - span :])


class _Sender:
    """Packed strings of a task, compressed by bucket. Each has a part (0 to 255, from its minimiser), a
    document, a place and a number of words; no words mean a range of known repeats of that many windows.

    Strings overlap, so until they are sent only their bounds are kept, beside the texts."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.docs, self.keys, self.texts = [], [], []
        self.columns = [array(kind) for kind in "Qiiiqq"]
        self.size = self.held = 0

    def add(self, doc: int, key: int, text: bytes, routes, starts, counts, begins, ends) -> None:
        """Strings of one text: routes, first words, counts and bounds; equal bounds if there are no words."""
        size = int((ends - begins).sum())
        rows = (routes, np.full(len(routes), len(self.docs)), starts, counts, begins, ends)
        for column, values, kind in zip(self.columns, rows, (np.uint64, *[np.int32] * 3, np.int64, np.int64)):
            column.frombytes(values.astype(kind).tobytes())
        self.docs.append(doc)
        self.keys.append(key)
        self.texts.append(text if size else b"")
        self.size += size
        self.held += len(self.texts[-1]) + 36 * len(routes)

    def full(self) -> bool:
        return max(self.size, self.held) >= SEND_BYTES

    def flush(self) -> pa.RecordBatch:
        routes, number, starts, counts, begins, ends = (np.array(c) for c in self.columns)
        bucket = (routes % np.uint64(self.buckets)).astype(np.int64)
        part = (routes >> np.uint64(56)).astype(np.uint8)
        order = np.lexsort((part, bucket))
        docs, keys = np.array(self.docs, np.int64), np.array(self.keys, np.int32)
        compressor = zstandard.ZstdCompressor(level=3)
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
        found, sent = [], []
        for low, high in zip(edges, edges[1:]):
            rows = order[low:high]
            texts = number[rows]
            bounds = zip(texts.tolist(), begins[rows].tolist(), ends[rows].tolist())
            strings = b"\n".join([self.texts[t][begin:end] for t, begin, end in bounds])
            columns = (part[rows], docs[texts], starts[rows], keys[texts], counts[rows])
            head = b"".join(c.tobytes() for c in columns)
            found.append(int(bucket[rows[0]]))
            sent.append(len(rows).to_bytes(8, "little") + compressor.compress(head + strings))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sent, pa.binary())], schema=_SENT_ARROW)


def _received(sent: bytes):
    """Rows (part, doc, place, count, words) of what a task sent to a bucket."""
    number = int.from_bytes(sent[:8], "little")
    data = zstandard.ZstdDecompressor().decompress(sent[8:])
    at, columns = 0, []
    for kind in (np.uint8, np.int64, np.int32, np.int32, np.int32):
        columns.append(np.frombuffer(data, kind, number, at))
        at += number * np.dtype(kind).itemsize
    part, docs, starts, keys, counts = columns
    places = (keys.astype(np.int64) << 32) | starts
    return zip(part.tolist(), docs.tolist(), places.tolist(), counts.tolist(), data[at:].split(b"\n"))


def _runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of equal minimisers, cut at ``MOST_WINDOWS``."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1))
    counts = np.diff(np.append(starts, len(low)))
    if counts.max() > MOST_WINDOWS:
        pieces = -(-counts // MOST_WINDOWS)
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end, starts = np.repeat(starts + counts, pieces), np.repeat(starts, pieces) + MOST_WINDOWS * inside
        counts = np.minimum(MOST_WINDOWS, end - starts)
    return starts, counts


def _pack(window: int, size: int, buckets: int):
    """Documents to packed super-k-mers."""

    def run(batches):
        word_hashes, sender = _WordHashes(), _Sender(buckets)
        for batch in slices(batches):
            docs = batch.column("doc").to_numpy()
            keys = batch.column("key").to_numpy()
            texts = utf8(batch.column("text"))
            seen: dict[bytes, int] = {}
            for row in np.argsort(docs, kind="stable").tolist():
                words = texts[row].split()
                if len(words) < window:
                    continue
                doc = int(docs[row])
                hashes = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
                low = _minimisers(hashes, window, size)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate(([0], ends[:-1] + 1))
                starts, counts = _runs(low)
                strings = begins[starts], ends[starts + counts + window - 2]
                packed = [joined[a:b] for a, b in zip(*(c.tolist() for c in strings))]
                known = np.array([seen.setdefault(p, doc) < doc for p in packed])
                lengths = np.where(known, counts, counts + window - 1)
                bounds = (np.where(known, 0, c) for c in strings)
                sender.add(doc, int(keys[row]), joined, low[starts], starts, lengths, *bounds)
                if sender.full():
                    yield sender.flush()
        if sender.docs:
            yield sender.flush()

    return run


def _rows(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW_ARROW)], schema=_ROW_ARROW)


def _repeated(packed: list[bytes], docs: list[int], places: list[int], words: list[int], window: int, powers: _Powers):
    """Ranges of windows that stand in a document with a smaller id: (doc, place, windows)."""
    text = b" ".join(packed)
    data = np.frombuffer(text, np.uint8)
    spaces = np.flatnonzero(data == 32)
    begins, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
    words = np.array(words, np.int64)
    row = np.repeat(np.arange(len(packed)), words)
    first = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    powers.grow(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers.up[: len(data)], dtype=np.uint64)))
    low, high = begins[first], ends[first + window - 1]
    hashes = (sums[high] - sums[low]) * powers.down[low]
    ids = np.array(docs, np.int64)[row[first]]
    order = np.lexsort((ids, hashes))
    hashes, ids, low, high = hashes[order], ids[order], low[order], high[order]
    edges = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
    runs = np.flatnonzero(ids[edges[1:] - 1] > ids[edges[:-1]])
    marked = []
    for begin, end in zip(edges[runs].tolist(), edges[runs + 1].tolist()):
        smallest: dict[bytes, int] = {}  # one entry, unless hashes of different words meet
        for i, doc, a, b in zip(
            range(begin, end), ids[begin:end].tolist(), low[begin:end].tolist(), high[begin:end].tolist()
        ):
            if smallest.setdefault(text[a:b], doc) < doc:
                marked.append(i)
    hits = np.sort(first[order[marked]]) if marked else np.zeros(0, np.int64)
    if not len(hits):
        return [], [], []
    rows = row[hits]
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(hits) != 1) | (np.diff(rows) != 0))))
    counts = np.diff(np.concatenate((heads, [len(hits)])))
    offset = hits[heads] - (np.cumsum(words) - words)[rows[heads]]
    return (
        np.array(docs, np.int64)[rows[heads]].tolist(),
        (np.array(places, np.int64)[rows[heads]] + offset).tolist(),
        counts.tolist(),
    )


def _single_windows(packed: bytes, doc: int, place: int, window: int):
    words = packed.split(b" ")
    for i in range(len(words) - window + 1):
        single = b" ".join(words[i : i + window])
        yield np.uint64(xxhash.xxh64_intdigest(single)).astype(np.int64).item(), doc, place + i, 1, single


class _Bucket:
    """What has come for one bucket so far."""

    def __init__(self, window: int, powers: _Powers):
        self.window, self.powers = window, powers
        self.spread: set[int] = set()
        self.rows: list[tuple] = []
        self.size = 0
        self.known: list[tuple] = []
        self.single: list[tuple] = []

    def add(self, row: tuple) -> None:
        part, doc, place, count, words = row
        if not words:
            self.known.append((doc, doc, place, count, None))
        elif part in self.spread:
            self.single += _single_windows(words, doc, place, self.window)
        else:
            self.rows.append(row)
            self.size += len(words)

    def look_for_large_parts(self) -> None:
        sizes = np.bincount([r[0] for r in self.rows], weights=[len(r[4]) for r in self.rows], minlength=256)
        large = set(np.flatnonzero(sizes > GROUP_BYTES).tolist())
        if large:
            self.spread |= large
            moved, self.rows = [r for r in self.rows if r[0] in large], [r for r in self.rows if r[0] not in large]
            self.size = sum(len(r[4]) for r in self.rows)
            for row in moved:
                self.add(row)

    def passed_on(self):
        rows, self.known, self.single = self.known + self.single, [], []
        for i in range(0, len(rows), 50_000):
            yield _rows(zip(*rows[i : i + 50_000]))

    def compared(self):
        self.rows.sort(key=lambda r: r[0])
        held: list[tuple] = []
        size = 0
        for i, row in enumerate(self.rows):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield self._block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
        if held:
            yield self._block(held)

    def _block(self, held: list[tuple]) -> pa.RecordBatch:
        _, docs, places, counts, words = map(list, zip(*held))
        docs, places, counts = _repeated(words, docs, places, counts, self.window, self.powers)
        return _rows((docs, docs, places, counts, [None] * len(docs)))


def _compare(window: int):
    """What tasks sent, in order of buckets, to ranges of repeated windows and single windows to go on."""

    def run(batches):
        powers = _Powers()
        current, bucket = None, _Bucket(window, powers)
        look = BUCKET_MOST
        for batch in batches:
            for route, sent in zip(batch.column("route").to_pylist(), batch.column("sent")):
                if route != current:
                    yield from bucket.compared()
                    current, bucket, look = route, _Bucket(window, powers), BUCKET_MOST
                for row in _received(sent.as_py()):
                    bucket.add(row)
                if bucket.size > look:
                    bucket.look_for_large_parts()
                    look = max(BUCKET_MOST, 2 * bucket.size)
                yield from bucket.passed_on()
        yield from bucket.compared()

    return run


def _stream(batches):
    """Single windows in order of (hash, document) to repeated windows; known ranges pass."""
    current, first = None, {}
    for batch in batches:
        passed = batch.filter(batch.column("words").is_null())
        if passed.num_rows:
            yield passed
        single = batch.filter(batch.column("words").is_valid())
        docs, places = [], []
        columns = (single.column(c).to_pylist() for c in ("route", "doc", "place", "words"))
        for route, doc, place, words in zip(*columns):
            if route != current:
                current, first = route, {}
            if first.setdefault(words, doc) < doc:
                docs.append(doc)
                places.append(place)
        if docs:
            yield _rows((docs, docs, places, [1] * len(docs), [None] * len(docs)))


def repeated_ranges(keyed: DataFrame, text_bytes: int, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """Ranges of windows that also start in a document with a smaller id: ``doc``, ``place``, ``extra``
    (number of windows), from rows (doc, key, text)."""
    buckets = max(1, math.ceil(EXPANSION * text_bytes / BUCKET_BYTES))
    number = max(keyed.sparkSession.sparkContext.defaultParallelism, buckets)
    packed = keyed.mapInArrow(_pack(window, size, buckets), _SENT)
    # What a task sends is at most SEND_BYTES, so a partition is sorted in few large rows.
    compared = packed.repartition(number, "route").sortWithinPartitions("route").mapInArrow(_compare(window), _ROW)
    return compared.repartition(number, "route").sortWithinPartitions("route", "doc").mapInArrow(_stream, _ROW)


_KEPT = StructType(
    [
        StructField("kept_text", StringType()),
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
    ]
)


def _cutter(window: int):
    @F.arrow_udf(_KEPT)
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        kept, totals, removed = [], [], []
        for value, found in zip(utf8(text), ranges.to_pylist()):
            words = value.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for packed in found or ():
                start, windows = packed >> 32, packed & 0xFFFFFFFF
                gone[start] += 1
                gone[min(len(words), start + windows + window - 1)] -= 1
            hidden = np.cumsum(gone[:-1]) > 0
            kept.append(b" ".join(w for w, h in zip(words, hidden.tolist()) if not h) if found else b" ".join(words))
            totals.append(len(words))
            removed.append(int(hidden.sum()))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            names=_KEPT.names,
        )

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove from every text the words covered by a window of words that also starts in a document
    with a smaller doc_id. Windows are judged on the input.

    All columns of ``docs`` (doc_id, text and any others) come back, with ``kept_text`` (the words that
    stay, joined by one space), ``n_words`` and ``n_removed``; these replace columns of the same name.

    A null or empty text, or one shorter than a window, loses nothing. Rows that share a doc_id do not
    remove words from each other. A null id counts as larger than every other; texts without id
    do not remove words from each other. An empty table gives an empty result.
    """
    row = docs.select(F.struct("*").alias("row"))
    key = F.xxhash64("row.text").bitwiseAND(0x7FFFFFFF)
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID))
    keyed = row.select("row", doc.alias("doc"), key.alias("key"))
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = repeated_ranges(keyed.select("doc", "key", F.col("row.text").alias("text")), text_bytes, window)
    start = F.col("place").bitwiseAND(0xFFFFFFFF)
    # At most one range for each word of the document, and the same range once.
    of_text = ranges.groupBy("doc", F.shiftright("place", 32).alias("key")).agg(
        F.collect_set(F.shiftleft(start, 32).bitwiseOR(F.col("extra"))).alias("ranges")
    )
    joined = keyed.join(of_text, ["doc", "key"], "left")
    # Not deterministic, as far as Spark is told: a filter on the result must not cut a text twice.
    cut = joined.select("row", _cutter(window).asNondeterministic()("row.text", "ranges").alias("cut"))
    names = [c for c in docs.columns if c not in _KEPT.names]
    return cut.select(*(F.col("row").getField(c).alias(c) for c in names), "cut.*")
