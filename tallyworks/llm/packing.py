"""Packing of token ids into sequences of equal length: concatenate and cut.

The documents' ids form one long stream, cut every ``length`` tokens; only the last sequence has
padding. Offsets in the stream come from prefix sums in two passes. The first pass encodes the
documents and writes each with its offset inside its partition; the partitions' totals, one row
each, are summed in order. The second pass adds its partition's offset to each document and cuts it
at the sequence bounds. No ids are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.texts import PieceEncoder, WordTable, kept, slices, token_bytes
from tallyworks.session import materialise

LENGTH = 2048

_TOKENS = "part int, part_start long, doc_id long, doc_tokens long, ids binary"
_TOKENS_ARROW = pa.schema(
    [("part", pa.int32()), ("part_start", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)
_PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continues boolean"
)
_PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("continues", pa.bool_()),
    ]
)


def _word_table(tokenizer_json: str) -> WordTable:
    return WordTable(PieceEncoder(tokenizer_json))


def encode_documents(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Ids of every document, each followed by ``end_id``, with offsets inside the partition."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    ending = token_bytes([end_id])

    def encode(batches):
        table = kept(_word_table, shared.value)
        part, position = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [found + ending for found in table.texts(batch.column("text"))]
            counts = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
            starts = position + np.cumsum(counts) - counts
            position += int(counts.sum())
            columns = [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(starts)]
            columns += [batch.column("doc_id"), pa.array(counts), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _TOKENS)


def cut_stream(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of encoded documents, each inside one sequence of ``length`` tokens."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row for each partition of the input, so a single task can sum them in order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches):
        for batch in slices(batches, "ids"):
            docs, counts, ids = (batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids"))
            rows = []
            for doc, count, data, first in zip(docs, counts, ids, batch.column("first").to_pylist()):
                start = 0
                while start < count:
                    sequence, offset = divmod(first + start, length)
                    taken = min(length - offset, count - start)
                    piece = data[4 * start : 4 * (start + taken)]
                    rows.append((doc, start, taken, piece, count, sequence, offset, start + taken < count))
                    start += taken
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PIECES_ARROW)

    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("base") + F.col("part_start")).alias("first")
    )
    return placed.mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text; other columns are ignored).

    Result, one row for each piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id``, ``offset`` in the sequence and ``continues`` (boundary record: the document
    goes on in the next sequence). Sequences are full but for the last one.

    A null or empty text has the end id only. Repeated rows and null ids are documents of their
    own. An empty table gives no piece. A document longer than a sequence spans several.
    """
    # Compressed ids are about half as large as the texts; written once, they are not encoded again.
    return cut_stream(materialise(encode_documents(docs, tokenizer_json, end_id), "packed", compression="zstd"), length)
