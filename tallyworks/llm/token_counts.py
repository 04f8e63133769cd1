"""Token counts by a finite-state transducer.

The vocabulary's automaton, read symbol by symbol, becomes a deterministic transducer: a transition
says how many tokens are certain once its symbol is read, a final weight how many more the end of
the word brings. Transitions are compiled when they are first needed.

A text is cut into chunks of fixed size, wherever the cuts fall. What a chunk does to the transducer
is its state map. White space brings the transducer back to its start, so the map of a chunk is the
same behind its first white space for every state in front: it consists of the bytes in front of
that white space, the tokens between the first and the last, and the bytes behind the last. Maps
compose; the composition is associative, so they are combined in pairs, in rounds, like a parallel
prefix scan.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.automaton import TokenAutomaton
from tallyworks.llm.texts import WordTable, byte_symbols, load_tokenizer, one_word, slices, utf8

CHUNK_BYTES = 16 << 10

_COUNTS = "doc_id long, n_bytes long, n_tokens long"
_COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

_SPACE = b" \t\n\v\f\r"


class PreSplit:
    """Special tokens and pre-split words of a piece of text, by the tokenizer's own rules."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = load_tokenizer(tokenizer_json)
        added = json.loads(tokenizer_json)["added_tokens"]
        self.special = {token["content"]: token["id"] for token in added}
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None

    def __call__(self, text: str) -> list[tuple[str, int]]:
        """Pairs (word, -1) and (special token, its id)."""
        if one_word(text) and text.lower() == text:
            return [(byte_symbols(text), -1)]
        out: list[tuple[str, int]] = []
        for part in self.pattern.split(text) if self.pattern and "<" in text else (text,):
            if part in self.special:
                out.append((part, self.special[part]))
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += ((word, -1) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return out


class CountingTransducer:
    """Counts the tokens of pre-split words.

    A state is a set of (trie node, last token, tokens not yet counted), one entry for each place
    where a token may have begun. A transition counts the tokens that all entries have in common.
    """

    def __init__(self, automaton: TokenAutomaton, max_transitions: int = 120_000):
        self.automaton = automaton
        self.max_transitions = max_transitions
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.arcs: dict[tuple[int, str], tuple[int, int]] = {}
        self.final: dict[tuple[int, str], int] = {}

    def _read(self, state: int, symbol: str):
        auto = self.automaton
        entries, ended, counted = [], -1, 0
        for node, last, count in self.states[state]:
            following = auto.child.get((node, symbol))
            if following is None:
                continue
            token = auto.token[following]
            if token >= 0 and auto.allows(last, token):
                ended, counted = token, count + 1
            if auto.inner[following]:
                entries.append((following, last, count))
        return entries, ended, counted

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        entries, ended, counted = self._read(state, symbol)
        entries.append((0, ended, counted))
        certain = min(count for _, _, count in entries)
        key = tuple((node, last, count - certain) for node, last, count in entries)
        following = self.number.get(key)
        if following is None:
            following = self.number[key] = len(self.states)
            self.states.append(key)
        arc = self.arcs[state, symbol] = (following, certain)
        return arc

    def count(self, word: str) -> int:
        if len(self.arcs) + len(self.final) > self.max_transitions:
            self._reset()
        state, total, arcs = 0, 0, self.arcs
        symbols = self.automaton.symbols(word)
        for symbol in symbols[:-1]:
            state, certain = arcs.get((state, symbol)) or self._compile(state, symbol)
            total += certain
        rest = self.final.get((state, symbols[-1]))
        if rest is None:
            rest = self.final[state, symbols[-1]] = self._read(state, symbols[-1])[2]
        return total + rest


class StateMap(NamedTuple):
    """What a chunk does: bytes up to its first white space, tokens behind, bytes behind its last.
    Without white space all bytes are in ``head`` and ``tail`` is None."""

    head: bytes
    tokens: int
    tail: bytes | None


def state_map(chunk: bytes, table: WordTable) -> StateMap:
    words = chunk.split()
    spaced_front, spaced_end = chunk[:1] in _SPACE, chunk[-1:] in _SPACE
    if not words:
        return StateMap(b"", 0, b"" if chunk else None)
    if len(words) == 1 and not spaced_front and not spaced_end:
        return StateMap(chunk, 0, None)
    head = b"" if spaced_front else words.pop(0)
    tail = b"" if spaced_end or not words else words.pop()
    return StateMap(head, sum(map(table.__getitem__, words)), tail)


def compose(first: StateMap, second: StateMap, table: WordTable) -> StateMap:
    """The map of two chunks in a row."""
    if first.tail is None:
        return StateMap(first.head + second.head, second.tokens, second.tail)
    if second.tail is None:
        return StateMap(first.head, first.tokens, first.tail + second.head)
    word = first.tail + second.head
    return StateMap(first.head, first.tokens + second.tokens + (table[word] if word else 0), second.tail)


def total(maps: list[StateMap], table: WordTable) -> int:
    """Tokens of the text whose chunks have these maps: combined in pairs until one is left."""
    while len(maps) > 1:
        pairs = [compose(a, b, table) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[2 * len(pairs) :]
    head, tokens, tail = maps[0]
    return tokens + (table[head] if head else 0) + (table[tail] if tail else 0)


def count_tokens(docs: DataFrame, tokenizer_json: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Tokens of every text of ``docs`` (doc_id, text; other columns are ignored), for a vocabulary
    that drops white space: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``.

    A null or empty text has no bytes and no tokens. Every row is counted on its own, also repeated
    rows and null ids. Strings of special tokens inside texts count as the library counts them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def count(batches):
        transducer = CountingTransducer(TokenAutomaton(shared.value))
        presplit = PreSplit(shared.value)
        table = WordTable(lambda text: sum(1 if known >= 0 else transducer.count(word) for word, known in presplit(text)))
        for batch in slices(batches):
            sizes, counts = [], []
            for text in utf8(batch.column("text")):
                chunks = [text[i : i + chunk_bytes] for i in range(0, len(text), chunk_bytes)] or [b""]
                sizes.append(len(text))
                counts.append(total([state_map(chunk, table) for chunk in chunks], table))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTS_ARROW
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, _COUNTS)
