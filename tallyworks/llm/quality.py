"""Quality rules, line by line first.

Every line is judged by three rules; lines that fail one are taken out, and a document that loses
too much of its text with them is rejected:

* punctuation: a line of prose ends in a closing mark or has the end of a sentence inside, and only
  some of its words end in doubled marks or symbols;
* navigation: separators between entries make up a good part of the line;
* boilerplate: the line holds a phrase that websites repeat on every page.

Base counts describe the whole text; too few words or too much repetition reject it at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tallyworks.llm.texts import SLICE_BYTES, utf8

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
#: A document that loses more than this share of its words with failed lines is rejected.
MOST_LOST_PERCENT = 30
#: A line fails when more than this share of its words end in doubled marks or symbols.
MOST_MARKED_PERCENT = 30
#: A line fails as navigation with at least so many separators, and this share of its words.
LEAST_SEPARATORS = 2
SEPARATOR_PERCENT = 15

SYMBOLS = b"#*$%&|<>"
CLOSING = tuple(m.encode() for m in (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "。", "！", "？"))
SENTENCE_ENDS = (b". ", b"! ", b"? ")
SEPARATORS = frozenset(s.encode() for s in ("|", "/", ">", ">>", "»", "›", "·", "•", "-", "::"))
PHRASES = (
    b"all rights reserved",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"terms and conditions",
    b"cookie policy",
    b"accept cookies",
    b"enable javascript",
    b"lorem ipsum",
    b"subscribe to our newsletter",
    b"click here",
    b"skip to content",
    b"back to top",
    b"powered by",
)

_MARKS = b"!?#*$%&|<>"

RESULT = StructType(
    [StructField("kept_text", StringType())]
    + [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
)


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """Name of the rule that the line fails. Lines without words pass."""
    if not words:
        return None
    number = len(words)
    separators = sum(w in SEPARATORS for w in words)
    if separators >= LEAST_SEPARATORS and 100 * separators > SEPARATOR_PERCENT * number:
        return "navigation"
    marked = sum(w[-1] in _MARKS and (w[-1:] not in b"!?" or w[-2:-1] in (b"!", b"?")) for w in words if len(w) > 1)
    if 100 * marked > MOST_MARKED_PERCENT * number:
        return "punctuation"
    if not line.rstrip().endswith(CLOSING) and not any(end in line for end in SENTENCE_ENDS):
        return "punctuation"
    lower = line.lower()
    if any(phrase in lower for phrase in PHRASES):
        return "boilerplate"
    return None


def repeated_words(words: list[list[bytes]], window: int = REPEAT_WINDOW) -> np.ndarray:
    """For every text, its words inside windows of ``window`` words that it holds twice or more.

    Windows get numbers by doubling: equal numbers for equal words, pairs, fours and so on, so they
    are compared exactly. ``window`` is a power of two.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for text in words for w in text), np.int64, int(sizes.sum()))
    if len(number) < window:
        return out
    text = np.repeat(np.arange(len(words)), sizes)
    span, different = 1, len(known)
    while span < window:
        number, found = pd.factorize(number[:-span] * different + number[span:])
        number, different, span = number.astype(np.int64), len(found), 2 * span
    first = np.flatnonzero(text[: len(number)] == text[window - 1 :])
    group, found = pd.factorize(number[first] * len(words) + text[first])
    twice = first[np.bincount(group, minlength=len(found))[group] > 1]
    edges = np.bincount(twice, minlength=len(text) + 1) - np.bincount(twice + window, minlength=len(text) + 1)
    return out + np.bincount(text, weights=np.cumsum(edges[: len(text)]) > 0, minlength=len(words)).astype(np.int64)


def _judge(texts: list[bytes]) -> list[list]:
    words = [text.split() for text in texts]
    repeats = repeated_words(words).tolist()
    columns: list[list] = [[] for _ in RESULT]
    for text, own, repeated in zip(texts, words, repeats):
        number, lost, duplicates = len(own), 0, 0
        seen: set[bytes] = set()
        stay = []
        for line in text.split(b"\n"):
            found = line.split()
            if found:
                duplicates += line in seen
                seen.add(line)
            if line_fails(line, found):
                lost += len(found)
            else:
                stay.append(line)
        failed = number < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * number
        kept = not failed and 100 * lost <= MOST_LOST_PERCENT * number
        values = (
            b"\n".join(stay),
            number,
            len(b"".join(own).decode()),
            len(text) - len(text.translate(None, SYMBOLS)),
            duplicates,
            repeated,
            lost,
            failed,
            kept,
        )
        for column, value in zip(columns, values):
            column.append(value)
    return columns


@F.arrow_udf(RESULT)
def _rules(text: pa.Array) -> pa.Array:
    texts = utf8(text)
    parts, begin, size = [], 0, 0
    for i, value in enumerate(texts):
        size += len(value)
        if size >= SLICE_BYTES or i + 1 == len(texts):
            parts.append(_judge(texts[begin : i + 1]))
            begin, size = i + 1, 0
    arrays = []
    for i, field in enumerate(RESULT):
        values = [v for part in parts for v in part[i]]
        kind = {"string": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}[field.dataType.simpleString()]
        array = pa.array(values, kind)
        arrays.append(array.cast(pa.string()) if kind == pa.binary() else array)
    return pa.StructArray.from_arrays(arrays, names=RESULT.names)


def judge(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text and any others) with the columns of ``RESULT``, which replace
    columns of the same name: ``kept_text`` (the text without failed lines), the counts,
    ``n_lost_words`` (in failed lines), ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike. An
    empty table gives an empty result.
    """
    row = docs.select(F.struct("*").alias("row"))
    # Not deterministic, as far as Spark is told: a filter on the result must not judge a text twice.
    judged = row.select("row", _rules.asNondeterministic()("row.text").alias("rules"))
    names = [c for c in docs.columns if c not in RESULT.names]
    return judged.select(*(F.col("row").getField(c).alias(c) for c in names), "rules.*")
