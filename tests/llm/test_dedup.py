"""SimHash links and substring removal against brute force."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import small

from tallyworks.llm import components, simhash, substring


def test_fingerprints_and_groups(spark):
    docs = small.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: small.simhash(t) for d, t in texts.items()}
    want = small.groups(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert (row.fingerprint, row.component_id) == (f"{prints[row.doc_id]:016x}", want[row.doc_id])


def test_links_lose_no_pair(spark):
    rng = random.Random(1)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(5):
            values.add(value)
            for _ in range(rng.randint(1, 3)):
                value ^= 1 << rng.randrange(64)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = simhash.distance_table(spark.createDataFrame([(v,) for v in values], "fp long"))
    found = {tuple(r) for r in simhash.links(table).collect()}
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found == want and want


def test_filed_fingerprints_stay_in_the_tasks(spark):
    """A fingerprint is filed in some thirty cells, which Spark counts as one: however small it takes the table for, it is not broadcast."""
    table = simhash.distance_table(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    text = simhash.links(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    rows = components.components(spark.createDataFrame(links, "a long, b long"), "test").collect()
    assert {r.id: r.root for r in rows} == {**{i: 0 for i in range(1, 21)}, **{100 + i: 100 for i in range(1, 30)}}


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "same words here and there"), (4, "same words here and there"), (None, "quite other words in this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect()) == [(0, 0), (0, 4), (4, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    left = substring.remove_repeats(spark.createDataFrame([(None, long), (9, long), (None, long)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in left.collect()) == [(0, 20), (0, 20), (9, 0)]


def test_removal_equals_brute_force_and_keeps_columns(spark):
    docs = small.documents(spark)
    want = small.without_repeats({r.doc_id: r.text for r in docs.collect()})
    left = substring.remove_repeats(docs)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "kept_text", "n_words", "n_removed"]
    rows = left.collect()
    assert len(rows) == docs.count() and {r.row for r in rows} == {"mine"}
    for row in rows:
        assert (row.n_words, row.n_removed, row.kept_text) == want[row.doc_id]


def test_large_groups_go_on_window_by_window(monkeypatch):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(30)]
    texts = {i: " ".join([f"a{rng.randrange(50)}" for _ in range(25)] + shared + [f"b{i}"] * 3) for i in range(40)}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array([5] * 40, pa.int64()), pa.array(texts.values())], names=["doc", "key", "text"]
    )
    want = small.without_repeats(texts)
    for most in (1 << 30, 200):
        monkeypatch.setattr(substring, "BUCKET_MOST", most)
        monkeypatch.setattr(substring, "GROUP_BYTES", most)
        monkeypatch.setattr(substring, "BLOCK_BYTES", 500)
        monkeypatch.setattr(substring, "SEND_BYTES", 1000)
        sent = [r for i in range(0, 40, 10) for b in substring._pack(13, 3, 2)(iter([batch.slice(i, 10)])) for r in b.to_pylist()]
        sent.sort(key=lambda r: r["route"])
        compared = list(substring._compare(13)(iter([pa.RecordBatch.from_pylist(sent, substring._SENT_ARROW)])))
        rows = sorted((r for b in compared for r in b.to_pylist()), key=lambda r: (r["route"], r["doc"]))
        assert any(r["words"] for r in rows) == (most == 200)
        ranges = [r for b in substring._stream(iter([pa.RecordBatch.from_pylist(rows, substring._ROW_ARROW)])) for r in b.to_pylist()]
        gone = {i: set() for i in texts}
        for r in ranges:
            start = r["place"] & 0xFFFFFFFF
            gone[r["doc"]].update(range(start, start + r["extra"] + 12))
        assert {i: len(g) for i, g in gone.items()} == {i: w[1] for i, w in want.items()}


def test_minimisers_are_the_smallest_hashes():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 60).astype(np.uint64)
    mers = substring._minimisers(hashes, 3, 3)
    want = [min(mers[i : i + 11].tolist()) for i in range(len(mers) - 10)]
    assert substring._minimisers(hashes, 13, 3).tolist() == want
