"""Token ids in files of independent zstandard frames.

Layout of a file, all numbers little-endian:

* frames: each holds the ids (unsigned 32-bit) of some documents in a row and ends in zstandard's
  own checksum of its content;
* a skippable frame with the document index: for every document its id (signed 64-bit; the smallest
  value stands for null) and its number of tokens (unsigned 32-bit), for every frame its documents
  (unsigned 32-bit);
* a skippable frame with the seek table of zstandard's seekable format: for every frame its
  compressed size, its size and the low 32 bits of its content's XXH64.

A reader fetches the end of a file, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.texts import PieceEncoder, SpacedTexts, kept, slices, token_bytes
from tallyworks.session import materialise, shared_folder

#: Ids that a frame holds at least, but for the last one of a file.
FRAME_IDS = 1 << 16

# Fixed values of the public formats.
_SEEK_MAGIC = 0x184D2A5E
_INDEX_MAGIC = 0x184D2A50
_FOOTER_MAGIC = 0x8F92EAB1
_WITH_CHECKSUMS = 0x80

_NULL_ID = -(1 << 63)

_FILES = "part int, path string, file_docs long, file_tokens long, file_bytes long"
_FILES_ARROW = pa.schema(
    [("part", pa.int32()), ("path", pa.string()), ("file_docs", pa.int64()), ("file_tokens", pa.int64()), ("file_bytes", pa.int64())]
)
_READ = "doc_id long, start long, n_tokens long, ids binary"
_READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark's file system gives it, as the file libraries name them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, rest = full.split(":", 1)
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest if rest.startswith("//") else "//" + rest, safe="/:@")


class FrameWriter:
    """Writes one file; documents come in the order in which they are stored."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        self.sink, self.frame_ids = sink, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.frame_docs: list[int] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.size = 0

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(_NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(data) >> 2)
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= 4 * self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        content = b"".join(self.held)
        packed = self.compressor.compress(content)
        self._write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.frame_docs.append(len(self.held))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = struct.pack("<II", len(self.ids), len(self.frames))
        index += np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        index += np.array(self.frame_docs, "<u4").tobytes()
        self._write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), _WITH_CHECKSUMS, _FOOTER_MAGIC)
        self._write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads the end of a file, then the frames of requested documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _FOOTER_MAGIC or flags != _WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * count
        source.seek(table_at)
        self.frames = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
        self.at = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        source.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != _INDEX_MAGIC:
            raise ValueError("no document index behind the frames")
        index = source.read(length)
        docs, frames = struct.unpack_from("<II", index)
        self.ids = np.frombuffer(index, "<i8", docs, 8)
        self.counts = np.frombuffer(index, "<u4", docs, 8 + 8 * docs).astype(np.int64)
        self.first_doc = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<u4", frames, 8 + 12 * docs), dtype=np.int64)))
        self.starts = np.cumsum(self.counts) - self.counts
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        """Content of a frame, checked."""
        packed, size, checksum = (int(x) for x in self.frames[number])
        self.source.seek(int(self.at[number]))
        content = self.decompressor.decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return content

    def documents(self, numbers) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids of the file before it, ids) of documents by their position in the file, ascending."""
        current, content = -1, b""
        for number in numbers:
            frame = int(np.searchsorted(self.first_doc, number, side="right")) - 1
            if frame != current:
                current, content = frame, self.frame(frame)
            begin = 4 * int(self.starts[number] - self.starts[self.first_doc[frame]])
            doc_id = int(self.ids[number])
            data = content[begin : begin + 4 * int(self.counts[number])]
            yield None if doc_id == _NULL_ID else doc_id, int(self.starts[number]), data


def _spaced_texts(tokenizer_json: str) -> SpacedTexts:
    return SpacedTexts(PieceEncoder(tokenizer_json, lead=" ", folds_case=False))


def write_files(docs: DataFrame, tokenizer_json: str, end_id: int, folder: str, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write their ids to ``folder`` in ascending order of doc_id.

    One row for each file: ``part`` (files in this order hold ascending ids), ``path`` and sizes. A
    task that is run again writes a file of its own name; only files listed here count. The list
    is written to the shared folder, so reading it never writes the files again.
    Rows with equal or null ids (null first) stand in the order of their texts' hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    ending = token_bytes([end_id])
    folder = qualified(docs.sparkSession, folder)

    def write(batches):
        table = kept(_spaced_texts, shared.value)
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
        files, where = _open(path)
        files.create_dir(os.path.dirname(where), recursive=True)
        with files.open_output_stream(where, compression=None) as sink:
            writer = FrameWriter(sink, frame_ids)
            for batch in slices(batches):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), table.texts(batch.column("text"))):
                    writer.add(doc_id, ids + ending)
            writer.close()
        row = [[context.partitionId()], [path], [len(writer.ids)], [sum(writer.counts)], [writer.size]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _FILES_ARROW)], schema=_FILES_ARROW)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return materialise(ordered.select("doc_id", "text").mapInArrow(write, _FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """All documents of the listed files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids``. Frame checksums are verified."""
    files = files.filter("file_docs > 0")
    number = max(1, files.count())
    # One row for each file, so a single task can sum them in order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "path", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                opened, where = _open(path)
                with opened.open_input_file(where) as source:
                    reader = FrameReader(source)
                    for low, high in zip(reader.first_doc, reader.first_doc[1:]):
                        found = list(reader.documents(range(int(low), int(high))))
                        columns = [
                            pa.array([doc for doc, _, _ in found], pa.int64()),
                            pa.array([base + start for _, start, _ in found], pa.int64()),
                            pa.array([len(data) >> 2 for _, _, data in found], pa.int64()),
                            pa.array([data for _, _, data in found], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, schema=_READ_ARROW)

    return placed.repartitionByRange(number, "part").select("path", "base").mapInArrow(read, _READ)


def read_documents(path: str, doc_ids: list[int]) -> dict[int, bytes]:
    """Ids of some documents of one file; only the frames that hold them are decompressed."""
    files, where = _open(path)
    with files.open_input_file(where) as source:
        reader = FrameReader(source)
        wanted = np.flatnonzero(np.isin(reader.ids, doc_ids))
        return {doc: data for doc, _, data in reader.documents(wanted.tolist())}


def new_folder(spark: SparkSession) -> str:
    """A folder for token files under the shared one."""
    return f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
