"""A BPE vocabulary as a deterministic automaton over its tokens.

The automaton has a state for every token (the one read last) and an arc for every token that
may follow it in a correct segmentation. It is built one merge at a time. The gadget of a merge
``(u, v) -> w`` changes the automaton of the earlier merges in three ways:

* every state with an arc ``u`` gets an arc ``w`` (``u`` then ``v`` is now one step),
* the state behind ``w`` starts as a copy of the state behind ``v``,
* the state behind ``u`` loses its arc ``v``.

Listing the arcs of 50,000 states would take billions of entries, so copies are kept as links to
the state and the version they were taken from; ``allows`` follows the links. A sequence of tokens
is the BPE segmentation of its text exactly if every token is allowed behind the one before.

Texts are read through a trie of the token strings. A reader's state is the set of places where a
token may have begun, each with the last token in front of it; reading a symbol is one table
lookup, and table entries are computed when they are first needed.
"""

from __future__ import annotations

import json

#: Symbols of a vocabulary with a word-end mark: the last symbol of a word moves up by this much.
END_SHIFT = 0x10000


def arc_labels(tokenizer_json: str) -> list[str]:
    """The text of every token, special ones included."""
    parsed = json.loads(tokenizer_json)
    named = [*parsed["model"]["vocab"].items(), *((t["content"], t["id"]) for t in parsed.get("added_tokens", ()))]
    labels = [""] * (max(token for _, token in named) + 1)
    for text, token in named:
        labels[token] = text
    return labels


class TokenAutomaton:
    """Merge gadgets, trie and labels of a BPE vocabulary in the tokenizers JSON form."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        self.birth = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        made: set[int] = set()
        self._parts: set[int] = set()
        for rank, pair in enumerate(model["merges"]):
            first, second = pair.split(" ") if isinstance(pair, str) else pair
            plain = first[: -len(self.suffix)] if self.suffix and first.endswith(self.suffix) else first
            made.add(vocab[plain + second])
            self._add_gadget(rank, vocab[first], vocab[second], vocab[plain + second])
        self._memo: dict[int, bool] = {}
        self._build_trie(vocab, made)

    def _add_gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.birth[u] >= rank or self.birth[v] >= rank or self.birth[w] >= 0 or w in self._parts:
            raise ValueError("merges must build on earlier merges, each for a token of its own")
        self._parts |= {u, v}
        if self._arc(u, v, rank):
            self.birth[w], self.left[w], self.right[w] = rank, u, v
            self.removed[u, v] = rank

    def _arc(self, x: int, y: int, version: int) -> bool:
        """Whether the state behind ``x`` has the arc ``y`` before gadget ``version``."""
        birth = self.birth
        while True:
            gone = self.removed.get((x, y))
            if gone is not None and gone < version:
                return False
            bx, by = birth[x], birth[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x, version = self.right[x], bx
            else:
                u = self.left[y]
                if x == u == self.right[y]:
                    return False
                y, version = u, by

    def allows(self, x: int, y: int) -> bool:
        """Whether token ``y`` may follow token ``x`` (-1: nothing yet) inside a word."""
        if x < 0:
            return True
        key = x << 32 | y
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) > 200_000:  # entries are recomputed when needed again
                self._memo.clear()
            known = self._memo[key] = self._arc(x, y, 1 << 60)
        return known

    def symbols(self, word: str) -> str:
        """The symbols of a pre-split word: its last one is marked if the vocabulary marks word ends."""
        return word[:-1] + chr(ord(word[-1]) + END_SHIFT) if self.suffix else word

    def _build_trie(self, vocab: dict[str, int], made: set[int]) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.token = [-1]
        self.inner = [False]
        for text, token in vocab.items():
            if token in made and self.birth[token] < 0:
                continue  # its gadget found no place: no segmentation holds it
            ended = self.suffix and text.endswith(self.suffix) and text != self.suffix
            node = 0
            for symbol in self.symbols(text[: -len(self.suffix)]) if ended else text:
                self.inner[node] = True
                following = self.child.get((node, symbol))
                if following is None:
                    following = self.child[node, symbol] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = following
            self.token[node] = token


#: Table entries of an encoder, of about 300 bytes; a full table is compiled anew.
MAX_TRANSITIONS = 400_000


class WordEncoder:
    """Token ids of pre-split words by transitions of the determinised automaton.

    A state is a set of (trie node, last token, pending ids): one entry for each place where a
    token may have begun. A transition emits the ids that all entries agree on.
    """

    def __init__(self, automaton: TokenAutomaton, max_transitions: int = MAX_TRANSITIONS):
        self.automaton = automaton
        self.max_transitions = max_transitions
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.table: dict[tuple[int, str], tuple[int, tuple[int, ...]]] = {}
        self.last: dict[tuple[int, str], tuple[int, ...]] = {}

    def _read(self, state: int, symbol: str):
        """Entries that go on behind ``symbol``, the token that ends there, and all pending ids."""
        auto = self.automaton
        entries, ended, whole = [], -1, ()
        for node, last, pending in self.states[state]:
            following = auto.child.get((node, symbol))
            if following is None:
                continue
            token = auto.token[following]
            if token >= 0 and auto.allows(last, token):
                ended, whole = token, (*pending, token)
            if auto.inner[following]:
                entries.append((following, last, pending))
        return entries, ended, whole

    def _step(self, state: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        entries, ended, whole = self._read(state, symbol)
        entries.append((0, ended, whole))
        shared = 0
        shortest = min(len(pending) for _, _, pending in entries)
        while shared < shortest and all(p[shared] == whole[shared] for _, _, p in entries):
            shared += 1
        key = tuple((node, last, pending[shared:]) for node, last, pending in entries)
        following = self.number.get(key)
        if following is None:
            following = self.number[key] = len(self.states)
            self.states.append(key)
        arc = self.table[state, symbol] = (following, whole[:shared])
        return arc

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        if len(self.table) + len(self.last) > self.max_transitions:
            self._reset()
        ids: list[int] = []
        state, table = 0, self.table
        symbols = self.automaton.symbols(word)
        for symbol in symbols[:-1]:
            arc = table.get((state, symbol)) or self._step(state, symbol)
            state = arc[0]
            ids += arc[1]
        rest = self.last.get((state, symbols[-1]))
        if rest is None:
            rest = self.last[state, symbols[-1]] = self._read(state, symbols[-1])[2]
        ids += rest
        return ids
