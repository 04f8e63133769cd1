"""The trie of conversation prefixes against brute force and its SQL twin."""

import hashlib
import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from tallyworks.llm import prefix_trie
from tallyworks.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 99, "mine") for r in rows], SCHEMA)


def rebuilt(rows) -> dict:
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def brute(rows) -> list[tuple]:
    convs = rebuilt(rows)
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert tuple(df.columns) == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(seed: int, convs: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 5 * convs), convs):
        for turn in range(rng.choice([0, 1, 3, 9, 12, 14])):
            rows.append((c, rng.choice([turn, None]) if turn < 2 else turn, rng.choice(["user", None, "é"]), rng.choice(["a", "", None, "日本" * 9])))
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0]]
    rows += [(10**6 + 5 * i, t, "user", f"same {t}") for i in range(convs // 2) for t in range(30)]
    rows += [(10**7, t, "user", f"deep {t}") for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes", [prefix_trie.BLOCK_BYTES, 200])
def test_trie_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 4)
    rows = sample(7, 60)
    assert found(prefix_trie.prefix_trie(table(spark, rows), block_bytes)) == brute(rows)


def test_very_common_turns_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 2)
    rows = [(c, t, "user", "hello" if t < 9 else f"{c % 7}") for c in range(0, 300, 3) for t in range(9 + c % 3)]
    assert found(prefix_trie.prefix_trie(table(spark, rows), 1)) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0
    for rows in ([(1, None, None, None)], [(3, 0, "user", "x")], [(5, 0, "u", "x" * 300_000), (5, 0, "u", "x" * 300_000)]):
        assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_registered_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, folder)) == brute(rows)
