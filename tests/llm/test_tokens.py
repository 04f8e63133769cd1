"""Packing, counting, files and BPE against the tokenizers library."""

import os
import random
import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import small

from tallyworks.llm import bpe, packing, token_counts, token_files
from tallyworks.llm.automaton import TokenAutomaton, WordEncoder
from tallyworks.llm.texts import PieceEncoder, SpacedTexts, WordTable, kept


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark):
    return small.documents(spark)


def test_counts_equal_the_library(docs):
    library = small.library(small.WORDS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for chunk in (5, 1 << 14):
        rows = token_counts.count_tokens(docs, small.vocabulary(small.WORDS), chunk).collect()
        assert len(rows) == docs.count()
        for row in rows:
            text = texts[row.doc_id]
            assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_bpe_equals_the_library_and_decodes(docs):
    library, vocabulary = small.library(small.WORDS), small.vocabulary(small.WORDS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert bytes(row.ids) == packed(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_automaton_needs_ordered_merges():
    model = '{"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3, "aa": 4}, "merges": [["a", "a"], ["a", "b"], ["ab", "a"]]}}'
    encoder = WordEncoder(TokenAutomaton(model))
    assert [encoder.encode(w) for w in ("aaa", "aaaa", "aba", "abab", "aaba")] == [[4, 0], [4, 4], [3], [2, 2], [4, 1, 0]]
    with pytest.raises(ValueError):
        TokenAutomaton('{"model": {"vocab": {"a": 0, "aa": 1, "aaa": 2}, "merges": [["aa", "a"], ["a", "a"]]}}')


def test_random_texts_through_small_tables():
    words, pieces = small.library(small.WORDS), small.library(small.BYTES)
    table = WordTable(PieceEncoder(small.vocabulary(small.WORDS)), 50)
    spaced = SpacedTexts(PieceEncoder(small.vocabulary(small.BYTES), " ", False), 50)
    rng = random.Random(3)
    parts = ["the", "Hello", "it's.", "É", "İ", "é", "́", " ", " ", "\n", "\x85", "\x1c", "<|endoftext|>", "<|", "!!", ",", "日本", "ß", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9)))
        ids = b"".join(table[w] for w in text.encode().split())
        assert ids == packed(words.encode(text, add_special_tokens=False).ids), text
        assert spaced.ids(text) == packed(pieces.encode(text, add_special_tokens=False).ids), text


AWKWARD = ["the", "Hello", "it's.", "É", "İ", "é", "H\u0331", "ª", "\u0301", " ", "\n", "\x85", "\x1c", "<|endoftext|>", "<|", "!!", ",", "日本", "ß", "\r\n"]


def test_whole_slices_equal_the_library():
    """Words of a slice are looked up together, also beyond what the tables hold."""
    words, pieces = small.library(small.WORDS), small.library(small.BYTES)
    table = WordTable(PieceEncoder(small.vocabulary(small.WORDS)), 5000)
    spaced = SpacedTexts(PieceEncoder(small.vocabulary(small.BYTES), " ", False), 5000)
    rng = random.Random(4)
    texts = ["".join(rng.choice(AWKWARD) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["", None, " ", "a\n\nb\nC. d", "x" * 3000, " ".join(f"Word{'abcdefgh'[i % 8] * (i % 90)}." for i in range(2500))]
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        column = pa.array(["left out", *some], pa.string()).slice(1)
        assert table.texts(column) == [packed(words.encode(t or "", add_special_tokens=False).ids) for t in some]
        assert spaced.texts(column) == [packed(pieces.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert table.texts(pa.array([], pa.string())) == spaced.texts(pa.array([], pa.string())) == []


def test_words_of_letters_cost_no_call_each():
    """Unseen words go to the library together: far fewer calls than words."""
    for table, lead in ((WordTable, ""), (SpacedTexts, " ")):
        vocabulary = small.vocabulary(small.WORDS if table is WordTable else small.BYTES)
        encoder, calls = PieceEncoder(vocabulary, lead, table is WordTable), []

        class Noted:
            tokenizer = encoder.tokenizer

            def __call__(self, text):
                calls.append(text)
                return encoder(text)

        rng = random.Random(6)
        text = " ".join("".join(rng.choices("abcdeö", k=9)).capitalize() + rng.choice(["", ".", ","]) for _ in range(5000))
        [ids] = table(Noted()).texts(pa.array([text]))
        assert ids == packed(small.library(small.WORDS if table is WordTable else small.BYTES).encode(text, add_special_tokens=False).ids)
        assert len(calls) < 10


def test_packing_fills_sequences_and_keeps_every_id(docs):
    library = small.library(small.WORDS)
    rows = packing.pack(docs.repartition(3), small.vocabulary(small.WORDS), 1, length=64).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, length in places:
        assert (sequence, offset) == divmod(at, 64) and len(range(length)) <= 64 - offset
        at += length
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.continues == (r.start + r.length < r.doc_tokens)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        want = packed(library.encode(d.text or "", add_special_tokens=False).ids + [1])
        copies = docs.filter(docs.doc_id == d.doc_id).count()
        got = sorted((r.start, bytes(r.ids)) for r in by_doc[d.doc_id])
        assert sum(len(x) for _, x in got) == copies * len(want)
        if copies == 1:
            assert b"".join(x for _, x in got) == want


def test_files_round_trip(spark, docs, tmp_path):
    library = small.library(small.BYTES)
    extra = docs.unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5, 0, "x")], docs.schema))
    files = token_files.write_files(extra, small.vocabulary(small.BYTES), 0, str(tmp_path / "out"), frame_ids=100)
    rows = token_files.read_files(files).collect()
    assert len(rows) == extra.count()
    texts = {r.doc_id: r.text or "" for r in extra.collect()}
    at = 0
    for row in sorted(rows, key=lambda r: r.start):
        want = packed(library.encode(texts[row.doc_id], add_special_tokens=False).ids + [0])
        assert (row.start, row.n_tokens, bytes(row.ids)) == (at, len(want) // 4, want)
        at += row.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order)


def test_files_find_documents_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    [file] = token_files.write_files(docs, small.vocabulary(small.BYTES), 0, str(tmp_path / "out"), frame_ids=300).collect()
    found = token_files.read_documents(file.path, [3, 31])
    assert sorted(found) == [3, 31]
    data = bytearray(open(file.path.removeprefix("file://"), "rb").read())
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    data[30] ^= 255
    open(file.path.removeprefix("file://"), "wb").write(data)
    with pytest.raises(Exception):
        token_files.read_documents(file.path, list(range(40)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    words, raw = small.vocabulary(small.WORDS), small.vocabulary(small.BYTES)
    assert packing.pack(empty, words, 1).count() == 0
    assert token_counts.count_tokens(empty, words).count() == 0
    assert bpe.decode(bpe.encode(empty, words), words).count() == 0
    assert token_files.read_files(token_files.write_files(empty, raw, 0, token_files.new_folder(spark))).count() == 0


def test_files_are_read_by_a_task_each(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    docs = small.documents(spark, [f"text {i}" for i in range(60)], repeat=False)
    files = token_files.write_files(docs, small.vocabulary(small.BYTES), 0, str(tmp_path / "plain path"))
    spark.conf.unset("spark.sql.adaptive.enabled")
    written = [r for r in files.collect() if r.file_docs]
    assert len(written) > 1 and all(r.path.startswith("file:///") for r in written)
    read = token_files.read_files(files)
    assert read.rdd.getNumPartitions() == len(written) and read.count() == 60


def test_kept_objects_outlive_a_task(spark):
    """Later tasks of a worker find what an earlier one made: far fewer objects than tasks."""
    def make(vocabulary):
        return vocabulary + uuid.uuid4().hex

    def run(batches):
        made = kept(make, "vocabulary")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([made] * batch.num_rows)], names=["made"])

    made = spark.range(0, 64, 1, 16).mapInArrow(run, "made string").distinct().count()
    assert made <= spark.sparkContext.defaultParallelism < 16
