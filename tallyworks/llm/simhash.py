"""SimHash fingerprints, linked through tables of distances to reference fingerprints.

For a reference r, ``|d(x, r) - d(y, r)| <= d(x, y)``: fingerprints within ``MOST`` bits of each other
differ by ``MOST`` at most in every column of the distance table, and pairs that differ more are
discarded unseen. The references are zero, one mask for each of 16 blocks of four bits, and eight
spread-out fingerprints.

* The distances to zero and to the masks give the weight of every block (its set bits). Two differing
  bits move the 16 weights by two steps in all, so two linked fingerprints have a vector of weights
  in common that is at most one step away from either. Every fingerprint is filed under its own
  vector and all vectors one step away (31 on average); only fingerprints filed together are compared.
* Of those pairs, the ones whose distances to any spread-out reference differ by more than ``MOST`` are
  discarded, and the rest is verified bit by bit.

Equal fingerprints are one entry, so a group of copies of any size is compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.components import components
from tallyworks.llm.texts import slices, utf8
from tallyworks.session import materialise

SHINGLE = 3
SEED = 42
MOST = 2

_BLOCKS = 16
_BITS = 4
_SPREAD = 8

_SCHEMA = "doc_id long, text_key long, fp long"
_SCHEMA_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text, signed: a bit is set if over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    columns = [words[i:] for i in range(size)]
    ones, number = np.zeros(64, np.int64), len(words) - size + 1
    for begin in range(0, number, 1 << 16):
        part = zip(*(c[begin : begin + (1 << 16)] for c in columns))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in part), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > number, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text) and ``fp`` of every row of ``docs`` (doc_id, text), written to
    the shared folder."""

    def run(batches):
        for batch in slices(batches):
            values = [fingerprint(text, shingle) for text in utf8(batch.column("text"))]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA_ARROW)

    return materialise(docs.select(F.col("doc_id").cast("long"), text_key(), "text").mapInArrow(run, _SCHEMA), "simhash")


def text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _distance(reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(reference)).cast("long"))).cast("long")


def distance_table(distinct: DataFrame) -> DataFrame:
    """Adds to fingerprints ``own`` (block weights plus one, a hexadecimal digit each, from the
    distances to zero and the masks) and ``far`` (distances to the spread-out references, a byte each)."""
    masks = [((1 << _BITS) - 1) << (_BITS * i) for i in range(_BLOCKS)]
    spread = [(0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64) for i in range(_SPREAD)]
    zero = F.lit(0).cast("long")
    weights = [F.shiftright(_distance(0) - _distance(m) + _BITS, 1) for m in masks]
    own = sum((F.shiftleft(w + 1, 4 * i) for i, w in enumerate(weights)), zero)
    far = sum((F.shiftleft(_distance(r), 8 * i) for i, r in enumerate(spread)), zero)
    return distinct.select("*", own.alias("own"), far.alias("far"))


def _filed(table: DataFrame) -> DataFrame:
    """Rows (cell, fp, far): every fingerprint under the weight vectors at most one step away."""
    own = F.col("own")
    digits = [F.shiftright(own, 4 * i).bitwiseAND(15) for i in range(_BLOCKS)]
    # Digits run from 1 to 5, so steps neither borrow nor carry.
    steps = [F.when(d <= _BITS, own + F.lit(1 << 4 * i)) for i, d in enumerate(digits)]
    steps += [F.when(d > 1, own - F.lit(1 << 4 * i)) for i, d in enumerate(digits)]
    return table.select("fp", "far", F.explode(F.array_compact(F.array(own, *steps))).alias("cell"))


def _far_apart(i: int) -> Column:
    a, b = (F.shiftright(F.col(c), 8 * i).bitwiseAND(0xFF) for c in ("far", "other_far"))
    return F.abs(a - b)


def links(table: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of different fingerprints of a distance table within ``most`` bits (up to ``MOST``)."""
    if not 0 <= most <= MOST:
        raise ValueError(f"fingerprints are filed for distances up to {MOST}")
    filed = _filed(table)
    other = filed.select("cell", F.col("fp").alias("other"), F.col("far").alias("other_far"))
    near = F.greatest(*(_far_apart(i) for i in range(_SPREAD))) <= most
    same = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most
    # An explode is sized by the rows in front of it, so Spark would send a table of some MB, thirty times as large
    # by then, through the driver; a merge join keeps it in the tasks.
    pairs = filed.join(other.hint("merge"), "cell").filter((F.col("fp") < F.col("other")) & near & same)
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``fingerprint`` (16 hex digits) and ``component_id`` of every row of
    ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest doc_id reachable over links of at most ``most`` differing bits, the
    own one included. A null, empty or blank text has fingerprint zero and is linked like any other. Rows
    with a null or repeated id are rows of their own; a group without any id has a null component.
    """
    prints = fingerprints(docs, shingle)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    table = materialise(distance_table(distinct), "simhash-distances")
    roots = components(links(table, most), "simhash-links").select(F.col("id").alias("fp"), "root")
    rooted = table.join(roots, "fp", "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    # Copies shrink the file of fingerprints, by which Spark would take their table for small enough to send around.
    return prints.join(named.hint("merge"), "fp").select("doc_id", "text_key", hexed, "component_id")


def without_copies(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest doc_id of each group of ``near_duplicates``.

    A row goes by its id and its text, so of rows that share an id only those go whose text has an
    earlier copy. Rows without an id stay.
    """
    groups = near_duplicates(docs, shingle, most)
    copies = groups.filter("doc_id > component_id").select("doc_id", "text_key").distinct()
    kept = docs.withColumn("_own_key", text_key())
    renamed = copies.select(F.col("doc_id").alias("_copy_id"), F.col("text_key").alias("_copy_key"))
    same = (kept["doc_id"] == renamed["_copy_id"]) & (kept["_own_key"] == renamed["_copy_key"])
    return kept.join(renamed, same, "left_anti").drop("_own_key")
