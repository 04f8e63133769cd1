"""Small documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

_PROSE = "The river ran past the old mill, and nobody in the village could say when it had last been still."
TEXTS = [
    _PROSE,
    _PROSE,
    _PROSE + " Then it rained.",
    None,
    "",
    " \n\t ",
    "short",
    "It's 12 o'clock<|endoftext|>and all is <|startoftext|> well!!  Two  spaces\n\n new line ",
    "Ünïcödé déjà-vu ΟΔΟΣ İstanbul 日本語 👍🏽 é",
    "word " * 300,
    "x" * 5000,
    " ".join(f"w{i}" for i in range(3000)),
    "intro one two " + " ".join(f"w{i}" for i in range(100, 140)) + " outro",
]


def documents(spark, texts=TEXTS, repeat=True):
    """Columns of documents and some that clash with names the operators use. Ids are not in order."""
    rows = [((7 * i) % len(texts), text, "en", "s", len(text or ""), -1, "mine") for i, text in enumerate(texts)]
    rows += rows[:1] if repeat else []
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string"
    return spark.createDataFrame(rows, schema)


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def simhash(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def groups(prints: dict) -> dict:
    """Smallest key reachable over at most two differing bits."""
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def without_repeats(texts: dict, window: int = 13) -> dict:
    first: dict[tuple, int] = {}
    out = {}
    for key in sorted(texts):
        words = (texts[key] or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), key) < key:
                gone.update(range(i, i + window))
        out[key] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    marks = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(len(w.decode()) for w in words), marks, len(lines) - len(set(lines)), len(inside)
