"""Quality rules, top-k, chats and licences."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import compare
import small
from pyspark.sql import functions as F

from tallyworks.llm import chat, licenses, quality, topk
from tallyworks.llm.oracles import ORACLES
from tallyworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "STAR", ["documents", "embeddings", "conversations"])
    assert compare.differences(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name]) == []


def test_base_counts(spark):
    docs = small.documents(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == small.base_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.row == "mine"
    assert quality.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A plain sentence that ends well.", None),
        ("A sentence ends. And then the text is cut off here", None),
        ("Home | About | Contact | Login", "navigation"),
        ("no closing mark on this one", "punctuation"),
        ("MUCH!! TOO!! LOUD!! THIS.", "punctuation"),
        ("Copyright 2020, all rights reserved.", "boilerplate"),
        ("", None),
    ],
)
def test_line_rules(line, rule):
    assert quality.line_fails(line.encode(), line.encode().split()) == rule


def test_documents_losing_too_much_are_rejected(spark):
    lines = [" ".join(f"l{i}w{j}" for j in range(10)) + "." for i in range(5)]
    texts = ["\n".join([*lines, "Home | News | Sport"]), "\n".join([lines[0], lines[1], "a | b | c | d e f g h i j k"])]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].kept and "Home" not in rows[0].kept_text and not rows[1].kept


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(300)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (550, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(600, [1.0, 2.0]), (601, [3.0, 4.0]), (250, rows[250][1])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    valid = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and i not in (400, 450, 500, 550)]
    for query, vector in valid:
        if query % 50 == 0 and query != 250:
            pairs = sorted((-int(vector @ v), i) for i, v in valid if i != query and len(v) == len(vector))[:5]
            assert sorted(got[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(pairs)]
    assert len(got[600]) == 1 and topk.top_k(found.sparkSession.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True), 5).count() == 0


def test_scores_beyond_doubles_are_exact():
    big = np.array([[2.0**40, 1.0]])
    assert topk.scores(big, np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]
    assert topk.scores(big, np.array([[2.0**40, 0.0]])).tolist() == [[(1 << 63) - 1]]


def test_chat_parts_and_escapes(spark):
    odd = "\\ <|im_end|>\n<s>[INST] <<SYS>> \\< </s> <\\| "
    rows = [
        (1, 1, "assistant", [("text", odd, None, None), ("image", None, "a.png", 4), None, ("video", None, "v", 2)]),
        (1, 0, None, [("text", None, None, None)]),
        (1, 1, "assistant", [("audio", None, "b.wav", None)]),
        (None, None, "us\ner\\", None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    out = chat.format_chats(turns).withColumn("read", chat.read_turns(chat.formatted())).withColumn("loss", chat.read_loss())
    by = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in by[1].read] == [("", ""), ("assistant", "<|audio|>"), ("assistant", odd + "<|image|><|other|>")]
    assert [tuple(a) for a in by[1].attachments] == [("audio", "b.wav", 0), ("image", "a.png", 1024), ("video", "v", 0)]
    assert by[1].expanded_tokens == 1024 and by[1].loss == "<|audio|>" + odd + "<|image|><|other|>"
    assert [tuple(t) for t in by[None].read] == [("us\ner\\", "")] and by[None].n_turns == 1
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_licence_rules(spark):
    texts = [
        "Text.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.",
        "Released under the MIT License. ALL RIGHTS RESERVED! Released under the MIT license",
        "You may not use this file except in compliance with the License.",
        None,
        "",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.n_sentences, r.n_known, r.licenses) for r in licenses.scan(docs).collect()}
    assert got == {0: (3, 2, "Apache-2.0"), 1: (3, 3, "MIT,all-rights-reserved"), 2: (1, 1, ""), 3: (0, 0, ""), 4: (0, 0, "")}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_notices(spark):
    texts = {
        "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
""",
        "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "MIT": """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice""",
        "BSD": """Redistribution and use in source and binary forms, with or without\r
modification, are permitted provided that the following conditions are met:\r
1. Redistributions of source code must retain the above copyright notice""",
        "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
  
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    }
    docs = spark.createDataFrame(list(texts.items()), "name string, text string")
    assert {r.name: r.licenses for r in licenses.scan(docs, notices=True).collect()} == {n: n for n in texts}


def test_very_long_roles(spark):
    role = "r\n\\" * 40_000
    turns = spark.createDataFrame([(1, 0, role, [("text", "hi", None, None)])], f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    [row] = chat.format_chats(turns).select(chat.read_turns(chat.formatted()).alias("read")).collect()
    assert [tuple(t) for t in row.read] == [(role, "hi")]


def test_very_long_runs_of_marks(spark):
    texts = ["." * 1_000_000, "a" + "?!" * 300_000 + " Released under the MIT License. b", "no end " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.n_known) for r in licenses.scan(docs).collect()}
    assert got == {0: (0, 0), 1: (3, 1), 2: (1, 0)}
