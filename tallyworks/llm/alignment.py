"""Alignment of two tokenizers over the same text, by skipping diagonal runs.

Both tokenizers cut the same bytes, so a token is known by the byte where it ends. From a common end on,
tokens are compared at the current index shift: equal stretches of the two end arrays are found by
probing lengths 1, 2, 4, ... and then halves, and skipped as one-to-one groups at once. Where the ends differ,
the shorter side advances until both end together; these tokens are one group, and the shift is the
new difference of the indexes.

How often two tokens are linked is counted over the whole corpus. The most frequent pairs, a fixed number of
rows, are sent to all tasks; documents look up the others by a join.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.texts import BYTE_SYMBOLS, TABLE_BYTES, Bounded, LetterTable, PieceEncoder, Pieces, SpacedTexts, kept, slices, token_bytes
from tallyworks.session import materialise

#: Rows of the broadcast table of pairs: 13 bytes each.
HEAD_PAIRS = 1 << 19

#: Bytes of text whose pieces are looked up together; ids, links and tables of two sides stand beside them.
SLICE_BYTES = 2 << 20

#: Distinct pairs that a counting task holds before it sends them on.
HELD_PAIRS = 1 << 21

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"
_ALIGNED_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.binary())]
)
_SUMMED = "n_best long, count_sum long, tail array<struct<pair:long,n:long>>"
_TAIL = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))


def one_to_one(a: list[int], b: list[int], i: int, j: int) -> int:
    """Length of the stretch in which ``a`` from ``i`` on and ``b`` from ``j`` on have the same ends."""
    run, size = 0, 1
    while (part := a[i : i + size]) and part == b[j : j + size]:
        taken = len(part)
        run, i, j = run + taken, i + taken, j + taken
        size *= 2
    while size > 1:
        size //= 2
        if (part := a[i : i + size]) and part == b[j : j + size]:
            run, i, j = run + len(part), i + len(part), j + len(part)
    return run


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side up to the end of every group, for two ascending end arrays with the same last end."""
    runs: list[int] = []  # tokens of A and of B up to the end of a run's first group, groups of the run
    i, j, count = 0, 0, len(a)
    while i < count:
        if a[i] == b[j]:
            run = one_to_one(a, b, i, j)
            runs += (i + 1, j + 1, run)
            i, j = i + run, j + run
            if i == count:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        runs += (i, j, 1)
    of_a, of_b, sizes = np.array(runs, np.int64).reshape(-1, 3).T
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(of_a, sizes) + inside, np.repeat(of_b, sizes) + inside


class ByteSide:
    """Tokens of a byte-level vocabulary behind a space; strings of special tokens are plain text."""

    def __init__(self, tokenizer_json: str):
        self.encoder = PieceEncoder(tokenizer_json, lead=" ", folds_case=False)
        self.encoder.tokenizer.encode_special_tokens = True
        self.table = SpacedTexts(self.encoder)
        self.table.inner.encode = self._ids_of
        self.table.letters.encode = self._ids_of_words
        self.exact = True
        vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
        back = {chr(symbol): byte for byte, symbol in BYTE_SYMBOLS.items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for text, token in vocabulary.items():
            if all(c in back for c in text):
                self.bytes[token] = bytes(back[c] for c in text)

    def found(self, pieces: Pieces) -> tuple[list[bytes | None], bool]:
        """Ids of every text, None where pieces cannot be told apart, and whether ids are known to give the text back."""
        return pieces.joined(self.table.behind_space(pieces.distinct)), self.exact

    def ids(self, text: str) -> bytes:
        return self.table.ids(" " + text)

    def _ids_of(self, piece: str) -> bytes:
        ids = self.encoder(piece)
        self._compare(ids, piece)
        return ids

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        """Ids of words behind a space."""
        ids = LetterTable.encode(self.table.letters, words)
        self._compare(ids.buffers()[2] or b"", "".join([" " + word for word in words.to_pylist()]))
        return ids

    def _compare(self, ids, text: str) -> None:
        if b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]) != text.encode():
            self.exact = False  # from now on every text is compared


class PieceSide:
    """Tokens of a sentencepiece model, which puts a space in front itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        # Where no piece has a space behind something else, text between spaces is encoded by itself.
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.table = Bounded(TABLE_BYTES)

    def _fill(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces behind a space; none for those that do not come back from their ids."""
        older = self.table.older
        out = {piece: older[piece] for piece in missing if piece in older}
        missing = [piece for piece in missing if piece not in out]
        for piece, ids in out.items():
            self.table.store(piece, ids)
        for piece, ids in zip(missing, self.processor.encode(missing, num_threads=1)):
            if b"".join(map(self.bytes.__getitem__, ids)) == b" " + piece.encode():
                out[piece] = self.table.store(piece, token_bytes(ids))
        return out

    def found(self, pieces: Pieces) -> tuple[list[bytes | None], bool]:
        """Ids of every text, None where text between spaces is not encoded by itself, and that they give the text back."""
        if not self.cuts:
            return [None] * (len(pieces.bounds) - 1), True
        told = pieces.distinct.to_pylist()
        ids = list(map(self.table.get, told))
        extra = self._fill([p for p, known in zip(told, ids) if known is None and p and "▁" not in p])
        values = [extra.get(p) if known is None else known for p, known in zip(told, ids)]
        return pieces.joined(pa.array(values, pa.large_binary())), True

    def ids(self, text: str) -> bytes:
        return token_bytes(self.processor.encode(text, num_threads=1))


class Aligner:
    """Groups and links of a text's tokens by both sides."""

    def __init__(self, byte_json: str, piece_model: str):
        self.a, self.b = ByteSide(byte_json), PieceSide(base64.b64decode(piece_model))
        self.size_b = len(self.b.bytes)
        self.kind = np.dtype("<u4") if len(self.a.bytes) * self.size_b <= 1 << 32 else np.dtype("<u8")
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.names = [
            [np.array([f"{i}{mark}" for i in range(len(side.bytes))], "S") for mark in marks]
            for side, marks in ((self.a, ",|"), (self.b, ",;"))
        ]

    def texts(self, column: pa.Array) -> Iterator[tuple | None]:
        """Of every text (tokens of A, tokens of B, groups, links, group text, pairs), None if a side does not give it back."""
        column = column.fill_null("")
        pieces = Pieces(column)
        (a, exact_a), (b, exact_b) = (side.found(pieces) for side in (self.a, self.b))
        for text, ids_a, ids_b in zip(column, a, b):
            text = text.as_py()
            yield self._aligned(text, [(ids_a, exact_a), (ids_b, exact_b)]) if text else None

    def _aligned(self, text: str, known: list[tuple[bytes | None, bool]]) -> tuple | None:
        whole = b" " + text.encode()
        found = []
        for side, lengths, (ids, exact) in zip((self.a, self.b), self.lengths, known):
            exact = exact and ids is not None
            ids = np.frombuffer(side.ids(text) if ids is None else ids, "<u4")
            if not exact and b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole:
                return None
            found.append((ids, np.cumsum(lengths[ids])))
        (a, ends_a), (b, ends_b) = found
        of_a, of_b = align(ends_a.tolist(), ends_b.tolist())
        pairs = self._links(a, ends_a, b, ends_b)
        return len(a), len(b), len(of_a), len(pairs), self._written(a, b, of_a, of_b), np.sort(pairs).tobytes()

    def _links(self, a, ends_a, b, ends_b) -> np.ndarray:
        """Pairs of tokens that share bytes. Between two neighbouring ends of either side lies exactly one."""
        beside_a = np.searchsorted(ends_b, ends_a)
        before_b = np.searchsorted(ends_a, ends_b)
        own_b = ends_a[before_b] != ends_b
        left = np.concatenate((a, a[before_b[own_b]])).astype(self.kind)
        right = np.concatenate((b[beside_a], b[own_b])).astype(self.kind)
        return left * self.kind.type(self.size_b) + right

    def _written(self, a, b, of_a, of_b) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group."""
        out = np.empty(len(a) + len(b), max(names.dtype for pair in self.names for names in pair))
        start_b = np.concatenate(([0], of_b[:-1]))
        size_a, size_b = np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(start_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(of_a, size_b)
        out[place_a] = self.names[0][0][a]
        out[place_a[of_a - 1]] = self.names[0][1][a[of_a - 1]]
        out[place_b] = self.names[1][0][b]
        out[place_b[of_b - 1]] = self.names[1][1][b[of_b - 1]]
        return out.tobytes().replace(b"\0", b"")[:-1].decode()


def align_documents(docs: DataFrame, byte_json: str, piece_model: bytes, digest: bool = False) -> DataFrame:
    """Groups and links of every text of ``docs`` (doc_id, text; other columns are ignored): ``doc_id``, ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``groups`` (ids as ``a1,a2|b1;...``, or its SHA-256 with ``digest``) and ``pairs`` (a token pair
    for each link, in ascending order, as unsigned integers of 4 or 8 bytes: id of A times the size of B's vocabulary plus id of B).

    A null or empty text, or one that a tokenizer does not give back byte for byte, has zeros, empty
    groups and no pairs. Every row is aligned on its own, also repeated rows and null ids.
    """
    model = base64.b64encode(piece_model).decode()
    shared = docs.sparkSession.sparkContext.broadcast((byte_json, model))  # two vocabulary files

    def run(batches):
        aligner = kept(Aligner, *shared.value)
        for batch in slices(batches, limit=SLICE_BYTES):
            rows = []
            for found in aligner.texts(batch.column("text")):
                found = found or (0, 0, 0, 0, "", b"")
                if digest and found[0]:
                    found = (*found[:4], hashlib.sha256(found[4].encode()).hexdigest(), found[5])
                rows.append(found)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ALIGNED_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=_ALIGNED_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``pair`` and ``n``: how many links of all documents hold it."""

    def run(batches):
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        pairs, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged():
            found, inverse = np.unique(np.concatenate([pairs, *(p for p, _ in fresh)]), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, inverse, np.concatenate([counts, *(n for _, n in fresh)]))
            return found, total

        for batch in slices(batches, "pairs"):
            data = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)
            found, n = np.unique(data, return_counts=True)
            fresh.append((found.astype(np.int64), n))
            if sum(len(p) for p, _ in fresh) > HELD_PAIRS:
                pairs, counts = merged()
                fresh = []
                if len(pairs) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], schema=schema)
                    pairs, counts = pairs[:0], counts[:0]
        if fresh:
            pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], schema=schema)

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """Adds ``best``: no other A id is linked more often with this pair's B id."""
    named = counts.withColumn("b", F.col("pair") % size_b)
    most = named.groupBy("b").agg(F.max("n").alias("most"))
    return named.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _look_up(aligned: DataFrame, table: DataFrame, kind: str, head_pairs: int) -> DataFrame:
    """Adds to documents the sums over links of the most frequent pairs, and the other pairs as ``tail``."""
    top = table.orderBy(F.desc("n"), "pair").limit(head_pairs).toArrow()  # a fixed number of rows at most
    order = np.argsort(top["pair"].to_numpy())
    head = [top[c].to_numpy()[order] for c in ("pair", "n", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(head)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches):
        pair, count, best = shared.value
        for batch in slices(batches, "pairs"):
            rows = []
            for data in batch.column("pairs").to_pylist():
                own = np.frombuffer(data, kind).astype(np.int64)
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at = at[known]
                left, n = np.unique(own[~known], return_counts=True)
                tail = [{"pair": p, "n": k} for p, k in zip(left.tolist(), n.tolist())]
                rows.append((int(best[at].sum()), int(count[at].sum()), tail))
            sums = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), _TAIL))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *sums], names=[*names, "n_best", "count_sum", "tail"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, " + _SUMMED
    return aligned.select(*names, "pairs").mapInArrow(run, schema)


def linked(docs: DataFrame, byte_json: str, piece_model: bytes, digest: bool = False, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``align_documents`` without its pairs, with two columns over a document's links: ``n_best``, those whose
    pair no other pair of the same B id beats in number over all documents, and ``count_sum``, the sum of these numbers.

    Nulls, empty texts, repeated rows and tables without rows are handled as there.
    """
    aligned = materialise(align_documents(docs, byte_json, piece_model, digest), "aligned", compression="zstd")
    sizes = Aligner(byte_json, base64.b64encode(piece_model).decode())
    kind, size_b = sizes.kind.str, sizes.size_b
    table = materialise(with_best(pair_counts(aligned, kind), size_b), "pair-counts")
    found = materialise(_look_up(aligned, table, kind, head_pairs).withColumn("row", F.monotonically_increasing_id()), "linked")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    rest = found.select("row", F.inline("tail").alias("pair", "times")).join(table, "pair")
    sums = rest.select(
        "row",
        *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in names),
        F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("times") * F.col("n")).alias("count_sum"),
    )
    both = found.select("row", *names, "n_best", "count_sum").unionByName(sums)
    grouped = both.groupBy("row").agg(*(F.max(n).alias(n) for n in names), *(F.sum(n).alias(n) for n in ("n_best", "count_sum")))
    return grouped.drop("row")
