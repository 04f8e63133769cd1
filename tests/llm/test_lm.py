"""Language-model scores against plain versions, and held-out accuracy."""

import math
import os
import sys
import tracemalloc
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import small

from tallyworks.llm import attention, lm_scoring
from tallyworks.llm.queries import QUERIES, TEXT_BEGIN, TEXT_END

FOLDER = "/root/testdata/sf0.001"


def base(rows) -> list[tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) of rows (id, text)."""
    told = [(zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(w for out, found in told if not out for w in found)
    number, distinct = sum(counts.values()), len(counts)
    divisor = number + 0.1 * (distinct + 1)
    return [
        (out, len(found), sum(counts[w] > 0 for w in found), number, math.fsum(math.log10((counts[w] + 0.1) / divisor) for w in found))
        for out, found in told
    ]


def check(rows, want):
    assert len(rows) == len(want)
    for r, (out, n_tokens, n_known, number, score) in zip(rows, want):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n_tokens, n_known, number)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and r.score < 0


@pytest.mark.parametrize("head", [lm_scoring.HEAD_WORDS, 20, 0])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    texts = small.TEXTS + ["y" * 5000 + " " + "z" * 60, "z" * 60 + " the"]
    docs = small.documents(spark, texts, repeat=False)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in lm_scoring.score(docs, small.vocabulary(small.WORDS), TEXT_BEGIN, TEXT_END, head).collect()}
    check([got[i] for i, _ in rows], base(rows))


def test_null_ids_repeated_rows_and_tables_without_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    schema = "doc_id long, text string, word string, n long, row long"
    for rows in ([(None, "a b"), (None, "a b"), (3, None), (3, "B b")], [(None, "a"), (None, None)], []):
        docs = spark.createDataFrame([(*r, "w", 7, 7) for r in rows], schema)
        got = lm_scoring.score(docs, small.vocabulary(small.WORDS), TEXT_BEGIN, TEXT_END).collect()
        key = lambda r: (r[0], r[1], r[4])
        check(sorted(got, key=lambda r: (r.held_out, r.n_tokens, r.base_score)), sorted(base(rows), key=key))


def numbers(size=300):
    counts = np.random.default_rng(3).integers(0, 50, size)
    vocabulary = attention.Vocabulary(counts)
    weights = {n: x.astype(np.float64) for n, x in attention.start(vocabulary).items()}
    rng = np.random.default_rng(4)
    for x in weights.values():
        x += rng.normal(0, 0.1, x.shape)
    return vocabulary, weights


def plain_log(weights, tokens, position, begin, end):
    """Log probability of the target at a position, one window at a time."""
    inputs = [begin, *tokens]
    targets = [*tokens, end]
    first = max(0, position // attention.STEP * attention.STEP - attention.STEP)
    seen = inputs[first : position + 1]
    x = weights["vectors"][seen]
    query = x[-1] @ weights["query"] / attention.WIDTH**0.5
    raw = np.array([query @ (v @ weights["key"]) + weights["distance"][len(seen) - 1 - i] for i, v in enumerate(x)])
    share = np.exp(raw - raw.max())
    share /= share.sum()
    read = x[-1] + sum(s * (v @ weights["value"]) for s, v in zip(share, x))
    inner = np.maximum(read @ weights["inner"] + weights["inner_bias"], 0)
    c, i = divmod(targets[position], attention.BLOCK)
    of_class = inner @ weights["classes"] + weights["class_bias"]
    of_token = inner @ weights["tokens"][c] + weights["token_bias"][c]
    return of_class[c] - np.log(np.exp(of_class).sum()) + of_token[i] - np.log(np.exp(of_token).sum())


def test_every_token_is_scored_once_as_by_a_plain_version():
    _, weights = numbers()
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 290, n) for n in (0, 1, 15, 16, 17, 31, 32, 100)]
    inputs, targets, rows = attention.windows(texts, 290, 291)
    got = attention.Scorer(weights)(inputs, targets, rows)
    want = [plain_log(weights, t.tolist(), p, 290, 291) for t in texts for p in range(len(t) + 1)]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(6).integers(0, 9, 5000)
    vocabulary = attention.Vocabulary(counts)
    weights = attention.start(vocabulary)
    text = np.array([5, 9, 4000])
    inputs, targets, rows = attention.windows([vocabulary.place[text]] * 5000, 0, 1)
    targets[rows, 3] = vocabulary.place
    logs = attention.Scorer(weights)(inputs, targets, rows).reshape(5000, 4)[:, 3]
    assert math.isclose(np.exp(logs + vocabulary.inside).sum(), 1, rel_tol=1e-4)


def test_gradients():
    _, weights = numbers()
    rng = np.random.default_rng(7)
    batch = attention.windows([rng.integers(0, 299, n) for n in (3, 20, 40)], 290, 291)
    loss, count, grads = attention.gradients(weights, *batch)
    for name, x in weights.items():
        for at in rng.choice(x.size, 6):
            if name == "vectors":
                at = batch[0].ravel()[at % batch[0].size] * attention.WIDTH + at % attention.WIDTH
            if name == "tokens":
                at = at % (9 * attention.HIDDEN * attention.BLOCK)
            flat, kept = x.reshape(-1), x.reshape(-1)[at]
            sides = []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                sides.append(attention.gradients(weights, *batch)[0] / count)
            flat[at] = kept
            assert math.isclose(grads[name].reshape(-1)[at], (sides[0] - sides[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-7), name


def test_registered_query_and_held_out_accuracy(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op12_lm_scoring"](spark, FOLDER).collect()}
    check([got[i] for i, _ in rows], base(rows))
    trained = sum(r.score for r in got.values() if r.held_out)
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)  # the unigram model of the same tokens
    untrained = sum(r.score for r in QUERIES["op12_lm_scoring"](spark, FOLDER).collect() if r.held_out)
    assert trained > 0.9 * untrained


def test_weights_are_averaged_in_rounds(spark):
    size = attention.flatten(attention.start(attention.Vocabulary(np.ones(50, np.int64)))).size
    rows = [([(i + 1) * lm_scoring._FIXED] * size,) for i in range(20)]
    learnt = spark.createDataFrame(rows, "weights array<long>").repartition(5)
    assert np.all(attention.flatten(lm_scoring._averaged(learnt, {})) == 10.5)


def test_every_training_text_is_learnt_from(spark, monkeypatch, tmp_path):
    """A corpus far beyond what one trainer goes through: no training text is left out."""
    monkeypatch.setattr(lm_scoring, "TRAINER_TOKENS", 64)
    folder = str(tmp_path)

    def note(trainer, texts, place, begin, end):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.writelines(f"{len(t)}\n" for t in texts)

    monkeypatch.setattr(lm_scoring, "_learn", note)
    rows = [(i, "a " * (i + 1)) for i in range(60)] + [(None, None), (0, "a"), (0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lm_scoring.score(docs, small.vocabulary(small.WORDS), TEXT_BEGIN, TEXT_END)
    seen = Counter(int(line) for path in tmp_path.iterdir() for line in path.read_text().split())
    ids = Counter(len((t or "").split()) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10)
    assert seen == ids  # every text once


def test_words_of_a_slice_are_those_of_plain_splitting():
    """Words of all texts of a slice at once."""
    texts = [" Ab  ab\x0bÖd\x1cx ", "", "   ", None, "z" * 60 + "\n\tZ"]
    distinct, codes, bounds = lm_scoring.words(lm_scoring.lowered(pa.array(["left out", *texts]).slice(1)))
    told = distinct.to_pylist()
    got = [[told[c] for c in codes[low:high]] for low, high in zip(bounds, bounds[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_a_step_of_learning_costs_little_more_than_its_sums():
    """Windows share their tokens: 128 windows read 129 rows, none twice."""
    vocabulary, weights = numbers()
    weights["vectors"] = weights["vectors"].view(Noted)
    rng = np.random.default_rng(9)
    inputs, targets, rows = attention.windows([rng.integers(0, 290, 3000)], 290, 291)
    Noted.read = 0
    attention.gradients(weights, inputs, targets, rows[:128])
    assert Noted.read <= 129 * attention.STEP


class Noted(np.ndarray):
    """Notes how many rows are read by index."""

    read = 0

    def take(self, at, *args, **kwargs):
        Noted.read += np.size(at)
        return np.asarray(self).take(at, *args, **kwargs)

    def __getitem__(self, at):
        Noted.read += np.size(at)
        return np.asarray(self)[at]


def test_steps_of_learning_use_the_same_arrays():
    """A step makes no fresh arrays of the size of its sums: they cost more than what is in them."""
    vocabulary, _ = numbers()
    rng = np.random.default_rng(11)
    batch = attention.windows([rng.integers(0, 290, 3000)], 290, 291)
    inputs, targets, rows = batch
    trainer = attention.Trainer(attention.start(vocabulary), 0.01)
    trainer.learn(inputs, targets, rows[:128])
    tracemalloc.start()
    trainer.learn(inputs, targets, rows[:128])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 128 * attention.STEP * 4 * attention.STEP  # eight bytes for each of 64 numbers a token; attention alone has 32


def test_texts_are_kept_as_short_ids():
    """Ids as the library gives them in two bytes each, and the words outside the head with their counts."""
    from tokenizers import Tokenizer

    vocabulary = small.vocabulary(small.WORDS)
    texts = ["A b  a cé zz zz", "", None, "  b " + "q" * 60]
    encoder = lm_scoring.Encoder(vocabulary)
    head = pa.table({"word": pa.array([b"a", b""], pa.binary()), "n": [3, 4]})
    n = len(texts)
    given = [pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array([0] * n, pa.int64()), pa.array(["left out", *texts]).slice(1)]
    got = lm_scoring.Coder(encoder, head, 10.0)(pa.RecordBatch.from_arrays(given, names=["doc_id", "held_out", "drawn", "text"])).to_pylist()
    whole = Tokenizer.from_str(vocabulary)
    assert encoder.kind.itemsize == 2
    for row, text in zip(got, texts):
        found = (text or "").encode().lower().split()
        assert np.frombuffer(row["ids"], encoder.kind).tolist() == whole.encode(text or "", add_special_tokens=False).ids
        assert {t["word"]: t["times"] for t in row["tail"]} == Counter(lm_scoring.key_of(w) for w in found if w != b"a")
        assert (row["n_tokens"], row["n_known"]) == (len(found) + 1, found.count(b"a") + 1)
        assert math.isclose(row["base"], found.count(b"a") * math.log10(0.31) + math.log10(0.41))


def test_four_thousand_tokens_have_places_of_their_own():
    """The model reads and predicts each of them by itself, not as one of the others by its count alone."""
    vocabulary = attention.Vocabulary(np.arange(1, 4001))
    assert len(set(vocabulary.place.tolist())) == 4000 and not vocabulary.inside.any()
    weights = attention.start(vocabulary)
    rare = [vocabulary.place[[5, 1500]], vocabulary.place[[1500, 5]]]
    grads = attention.gradients(weights, *attention.windows(rare, 0, 1))[2]
    assert np.abs(grads["vectors"][vocabulary.place[[5, 1500]]]).sum(axis=1).all()
    assert grads["token_bias"].reshape(-1)[vocabulary.place[[5, 1500]]].all()
