"""The pipeline on small documents, stage by stage against brute force."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

import small

import corpus_pipeline
from tallyworks.llm import quality


def test_stages_against_brute_force(spark, tmp_path):
    lines = [" ".join(f"v{i}x{j}" for j in range(30)) + "." for i in range(12)]
    texts = [f"{a}\n{b}\n{lines[0]}" for a, b in zip(lines[1::2], lines[2::2])] + [lines[3] + "\nHome | News | Sport", "junk", None]
    texts += texts[:2]
    small.documents(spark, texts, repeat=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for r in docs.collect():
        stay = [x for x in (r.text or "").split("\n") if not quality.line_fails(x.encode(), x.encode().split())]
        lost = len((r.text or "").split()) - sum(len(x.split()) for x in stay)
        words = len((r.text or "").split())
        if words >= 20 and 100 * lost <= 30 * words:
            kept[r.doc_id] = "\n".join(stay)
    got = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id: r.text for r in got.collect()} == kept
    root = small.groups({d: small.simhash(t) for d, t in kept.items()})
    left = {d: t for d, t in kept.items() if root[d] == d}
    got = corpus_pipeline.near_dedup(spark, got, str(tmp_path))
    assert {r.doc_id: r.text for r in got.collect()} == left and len(left) < len(kept)
    cut = small.without_repeats(left)
    want = {d: t if not cut[d][1] else cut[d][2] for d, t in left.items() if cut[d][1] < cut[d][0]}
    got = corpus_pipeline.substring_dedup(spark, got, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id: r.text for r in got.collect()} == want
    library = small.library(small.WORDS)
    ids = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert {d: len(x) // 4 for d, x in ids.items()} == {
        d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()
    }


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(4, text), (9, text), (9, other), (None, text), (None, None), (12, ""), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, -1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, text), (9, other), (None, text), (None, None), (11, None)], key=str)


def test_large_groups_of_copies(spark):
    """Copies by the thousand and edits within two bits: one of each group stays."""
    rng = random.Random(8)
    texts = []
    for k in range(5):
        texts += [" ".join(f"g{k}w{rng.randrange(10**6)}" for _ in range(400))] * 300
    words = [f"large{i}" for i in range(3000)]
    texts += [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 600, 20)]
    docs = small.documents(spark, texts, repeat=False)
    ids = {r.doc_id: r.text for r in docs.collect()}
    root = small.groups(prints := {t: small.simhash(t) for t in set(texts)})
    first = {}
    for i, t in ids.items():
        first[root[t]] = min(i, first.get(root[t], i))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(first.values()) and len(got) < len(prints)


def test_empty_table(spark, tmp_path):
    small.documents(spark, [], repeat=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_sends_no_row_of_every_document_around(spark):
    """The file of fingerprints is small where texts repeat; its rows stay in the tasks all the same."""
    docs = spark.range(50).selectExpr("id as doc_id", "'a b c d' as text", "'en' as lang", "'s' as source", "7L as n_chars")
    text = corpus_pipeline.near_dedup(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(\w+=\w+\))? \[fp#", text) and not re.search(r"BroadcastHashJoin \[fp#\w+\], \[fp#\w+\], Inner", text)
