"""Alignment of two tokenizers against the libraries and a plain version."""

import base64
import hashlib
import os
import random
import sys
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(__file__))

import small

from tallyworks.llm import alignment
from tallyworks.llm.queries import PIECE_MODEL, QUERIES

MODEL = open(PIECE_MODEL, "rb").read()


def tokens(text):
    """(id, bytes) of both sides, or None."""
    if not text:
        return None
    library = small.library(small.BYTES)
    library.encode_special_tokens = True
    back = {chr(s): b for b, s in alignment.BYTE_SYMBOLS.items()}
    a = [(i, bytes(back[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    b = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def spans(side):
    at, out = 0, []
    for i, data in side:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts):
    """Result rows by position in ``texts``."""
    links, rows = [], []
    for text in texts:
        found = tokens(text)
        if not found:
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        a, b = map(spans, found)
        links.append([(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 3000 else None)
        if links[-1] is None:  # the same by a merge, for long texts
            own, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                own.append((a[i][0], b[j][0]))
                end_a, end_b = a[i][2], b[j][2]
                i, j = i + (end_a <= end_b), j + (end_b <= end_a)
            links[-1] = own
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        by_a, by_b = iter(a), iter(b)
        for cut in cuts:
            parts = []
            for side in (by_a, by_b):
                part = []
                for token, _, end in side:
                    part.append(str(token))
                    if end == cut:
                        break
                parts.append(",".join(part))
            groups.append("|".join(parts))
            low = cut
        assert low == len((" " + text).encode())
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for own in links for p in own)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [
        (n_a, n_b, n_groups, len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest)
        for (n_a, n_b, n_groups, digest), own in zip(rows, links)
    ]


EXTRA = [" lead", "a  b", "tab\tand\r\nline", "</s><s> x", "a▁b", "x\x00y", " ", "no break  ", "ﬁ ligature", "日本語" * 400]


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 50, 0])
def test_linked_equals_brute_force(spark, head):
    texts = small.TEXTS + EXTRA
    docs = small.documents(spark, texts, repeat=False)
    ids = [r.doc_id for r in docs.collect()]
    assert len(set(ids)) == len(texts)
    got = {r.doc_id: r for r in alignment.linked(docs, small.vocabulary(small.BYTES), MODEL, True, head).collect()}
    for doc_id, want in zip(ids, brute(texts)):
        r = got.pop(doc_id)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want
    assert not got


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "same text", 1), (None, "same text", 2), (3, None, 3), (3, "same text", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair long")
    out = alignment.linked(docs, small.vocabulary(small.BYTES), MODEL).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "3", "None", "None"]
    full = [r for r in out if r.n_a]
    assert len(full) == 3 and all(r.count_sum == 3 * r.n_links and r.n_best == r.n_links for r in full)
    assert full[0].groups.count("|") == full[0].n_groups
    assert alignment.linked(docs.limit(0), small.vocabulary(small.BYTES), MODEL).count() == 0


def test_pieces_of_a_slice_are_looked_up_together():
    """Every distinct piece once a slice, with the results of text by text."""
    aligner = alignment.Aligner(small.vocabulary(small.BYTES), base64.b64encode(MODEL).decode())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Haus", "unter.", "x1", "déjà", "a\nB", "日本", "na-na"]) for _ in range(9)) for _ in range(60)] + EXTRA + ["", None]
    calls, fill = [], aligner.b._fill
    aligner.b._fill = lambda missing: calls.append(missing) or fill(missing)
    rows = list(aligner.texts(pa.array([None, *texts], pa.string()).slice(1)))
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0])
    for r, want in zip(rows, brute(texts), strict=True):
        found = (*r[:4], hashlib.sha256(r[4].encode()).hexdigest()) if r else (0, 0, 0, 0, "")
        assert found == (*want[:4], want[-1])


def test_runs_are_skipped_exactly():
    rng = random.Random(2)
    for _ in range(400):
        end = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randrange(0, end + 1)), end}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*a, *b[:2]} - set(rng.sample(a[:-1], min(1, len(a) - 1))))
        of_a, of_b = alignment.align(a, b)
        cuts = sorted({*a} & {*b})
        assert [a[i - 1] for i in of_a.tolist()] == cuts == [b[j - 1] for j in of_b.tolist()]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, folder).collect()}
    for (doc_id, _), want in zip(rows, brute([t for _, t in rows])):
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want
