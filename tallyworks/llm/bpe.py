"""BPE encoding and decoding by the automaton of the vocabulary (see ``automaton.py``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.automaton import TokenAutomaton, WordEncoder, arc_labels
from tallyworks.llm.texts import SLICE_BYTES, WordTable, kept, slices, token_bytes, utf8
from tallyworks.llm.token_counts import PreSplit

_ENCODED = "doc_id long, ids binary"
_ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DECODED = "doc_id long, ids binary, decoded string"
_DECODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


class TextEncoder:
    """Ids of texts by the automaton, as bytes, word by word through a table."""

    def __init__(self, tokenizer_json: str):
        self.encoder = WordEncoder(TokenAutomaton(tokenizer_json))
        self.presplit = PreSplit(tokenizer_json)
        self.table = WordTable(self._word)

    def _word(self, text: str) -> bytes:
        found: list[int] = []
        for word, known in self.presplit(text):
            found += [known] if known >= 0 else self.encoder.encode(word)
        return token_bytes(found)

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, text.split()))


class ArcLabels:
    """Texts of ids: the labels of the arcs they name, with a space between them."""

    def __init__(self, tokenizer_json: str):
        self.emitted = pa.array(arc_labels(tokenizer_json), pa.string())

    def __call__(self, coded: list[bytes]) -> pa.Array:
        ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum([len(x) >> 2 for x in coded]))).astype(np.int32)
        arcs = pa.ListArray.from_arrays(pa.array(offsets), self.emitted.take(pa.array(ids)))
        return pc.binary_join(arcs, " ")


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Ids of every text of ``docs`` (doc_id, text; other columns are ignored): ``doc_id``, ``ids``
    (little-endian unsigned 32-bit), for a vocabulary that drops white space.

    A null or empty text has no ids. Every row is encoded on its own, also repeated rows and null
    document ids. Strings of special tokens inside texts become their ids, as in the library.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches):
        encoder = kept(TextEncoder, shared.value)
        for batch in slices(batches):
            coded = [encoder(text) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.binary())], schema=_ENCODED_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """Adds ``decoded``: the labels of the arcs that the ids name, with a space between them, as a
    vocabulary without a decoder is read. Null ids are read as none; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches):
        labels = kept(ArcLabels, shared.value)
        for batch in slices(batches, "ids"):
            decoded = labels(batch.column("ids").fill_null(b"").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded], schema=_DECODED_ARROW)

    return encoded.select("doc_id", "ids").mapInArrow(run, _DECODED)


def round_trip(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """``encode``, then ``decode``, in one pass over the texts: ``doc_id``, ``ids``, ``decoded``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches):
        encoder, labels = kept(TextEncoder, shared.value), kept(ArcLabels, shared.value)
        for batch in slices(batches, limit=SLICE_BYTES // 4):
            coded = [encoder(text) for text in utf8(batch.column("text"))]
            columns = [batch.column("doc_id"), pa.array(coded, pa.binary()), labels(coded)]
            yield pa.RecordBatch.from_arrays(columns, schema=_DECODED_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DECODED)
