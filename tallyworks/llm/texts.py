"""Texts in Arrow batches: slices of bounded size and word tables with bounded memory."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cached_property
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker handles at a time; a longer text makes a slice of its own.
SLICE_BYTES = 8 << 20

#: Bytes of keys and values of a word table. A full table becomes the older one, which is asked before
#: a word is encoded again; the older one before it goes. This changes no result.
TABLE_BYTES = 48 << 20

#: Longer words are encoded every time and never stored.
STORED_WORD = 200

#: Encoders and tables that a Python worker keeps for its next tasks.
KEPT = 4
_KEPT_MODULE = "_tallyworks_kept"


def kept(make: Callable, *args: str):
    """``make(*args)``, made once in a worker process and kept for its later tasks. Arguments are vocabularies;
    the least recently used of more than ``KEPT`` objects goes.

    This package travels to the workers by value, so its own globals are new in every task. What stays is
    held by a module that is registered in the process.
    """
    holder = sys.modules.setdefault(_KEPT_MODULE, ModuleType(_KEPT_MODULE))
    objects = holder.__dict__.setdefault("objects", OrderedDict())
    key = make.__module__, make.__qualname__, *(hashlib.sha256(a.encode()).digest() for a in args)
    if key not in objects:
        while len(objects) >= KEPT:
            objects.popitem(last=False)
        objects[key] = make(*args)
    objects.move_to_end(key)
    return objects[key]


class Bounded(dict):
    """A dictionary of words with bounded memory."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.older: dict = {}

    def store(self, word, value):
        if len(word) > STORED_WORD:
            return value
        used = self.used + sys.getsizeof(word) + sys.getsizeof(value) + 100
        if used > self.limit:
            self.older = dict(self)
            self.clear()
            used -= self.used
        self.used = used
        self[word] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null text is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


class Pieces:
    """Pieces between single spaces of a column of texts without nulls: the distinct ones, their codes in order, and where the
    codes of a text start and end."""

    def __init__(self, column: pa.Array):
        pieces = pc.split_pattern(column, " ")
        coded = pieces.flatten().dictionary_encode()
        self.distinct, self.codes, self.bounds = coded.dictionary, coded.indices.to_numpy(), pieces.offsets.to_numpy()

    def joined(self, values: pa.Array, codes: np.ndarray | None = None, bounds: np.ndarray | None = None) -> list[bytes | None]:
        """Of every text the values of its codes, one behind the other; None if one of them is null."""
        codes, bounds = (self.codes, self.bounds) if codes is None else (codes, bounds)
        missing = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False)[codes])))[bounds]
        found = joined(values, pa.array(codes), bounds)
        return [ids if whole else None for ids, whole in zip(found, (np.diff(missing) == 0).tolist())]


def joined(values: pa.Array, codes: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """Of every text the values of its codes, one behind the other; ``bounds``: where the texts' codes start and end."""
    taken = values.take(codes)
    _, ends, data = taken.buffers()
    at = np.frombuffer(ends, np.int64)[bounds].tolist()
    view = memoryview(data or b"")
    return [bytes(view[low:high]) for low, high in zip(at, at[1:])]


class LetterTable:
    """Ids of words of Latin letters, which go to the tokenizer's model behind ``lead``, many at a time. Words and ids
    lie in Arrow arrays; beyond ``limit`` bytes the older half of the words goes."""

    def __init__(self, model, lead: str, limit: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lead, self.limit = lead, limit
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __call__(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        missing = at.is_null()
        fresh = words.filter(missing)
        known, ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, self.encode(fresh)])
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(fresh))
        kept_from = 0
        while kept_from < len(known) and known[kept_from:].nbytes + ids[kept_from:].nbytes > self.limit:
            kept_from += -(-(len(known) - kept_from) // 2)
        newer = pa.array(np.arange(kept_from, len(known)))
        self.words, self.ids = (known.take(newer), ids.take(newer)) if kept_from else (known, ids)
        return ids.take(pa.array(place))

    def encode(self, words: pa.Array) -> pa.Array:
        counts, found = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for low in range(0, len(words), _TOGETHER):
            some = words.slice(low, _TOGETHER).to_pylist()
            text = self.lead + ("\n" + self.lead).join(some)
            encoded = self.tokenizer.encode(text.encode().decode("latin-1").translate(_SYMBOLS_OF_LINES), add_special_tokens=False)
            counts.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(some)))
            found.append(np.array(encoded.ids, "<u4"))
        ends = 4 * np.cumsum(np.concatenate([[0], *counts]), dtype=np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(found))])


def letters_and_marks(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which of the words are Latin letters and marks behind them, and both parts of these."""
    plain = pc.match_substring_regex(words, _LETTERS_AND_MARKS)
    words = words.filter(plain)
    core = pc.ascii_rtrim(words, characters=_MARKS)
    return plain.to_numpy(zero_copy_only=False), core, pc.utf8_ltrim(words, characters=_LATIN_1).dictionary_encode()


def in_parts(plain: np.ndarray, of_core: pa.Array, marks: pa.Array, of_marks: list, others: list) -> pa.Array:
    """Values of all words: of the letters and the marks behind them where ``plain``, else the next of ``others``."""
    of_marks = pa.array(of_marks, pa.large_binary()).take(marks.indices)
    whole = pc.binary_join_element_wise(of_core, of_marks, pa.scalar(b"", pa.large_binary()))
    values = pa.concat_arrays([whole, pa.array(others, pa.large_binary())])
    place = np.empty(len(plain), np.int64)
    place[plain], place[~plain] = np.arange(len(whole)), len(whole) + np.arange(len(others))
    return values.take(pa.array(place))


def load_tokenizer(tokenizer_json: str):
    """The library's tokenizer, without truncation, padding and threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


# The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SYMBOLS = {b: b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b)) for b in range(256)}


def byte_symbols(text: str) -> str:
    """The text's UTF-8 bytes in the byte-level alphabet."""
    return text if text.isalpha() and text.isascii() else text.encode().decode("latin-1").translate(BYTE_SYMBOLS)


def one_word(text: str) -> bool:
    """Whether the text consists of Latin letters, so that no pre-split rule takes it apart and
    composing its characters changes nothing."""
    return text.isalpha() and max(text) < _LATIN_END


class PieceEncoder:
    """Ids of a piece of text by the library's tokenizer. What the pre-split rules leave whole for sure goes
    to its model at once: words of Latin letters (behind ``lead``), in lower case if the vocabulary folds case,
    and runs of printable ASCII characters of one kind."""

    def __init__(self, tokenizer_json: str, lead: str = "", folds_case: bool = True):
        self.tokenizer = load_tokenizer(tokenizer_json)
        self.tokenize = self.tokenizer.model.tokenize
        self.lead, self.skip, self.folds_case = lead, len(lead), folds_case
        self.whole = (_FOLDED if folds_case else _SPACED).fullmatch

    def __call__(self, text: str) -> bytes:
        if text.isalpha() and text.isascii() and (text.islower() or not self.folds_case):
            return token_bytes([token.id for token in self.tokenize(text)])
        if self.whole(text) and "<|" not in text:
            return token_bytes([token.id for token in self.tokenize(text.replace(" ", _SPACE_SYMBOL))])
        word = text[self.skip :]
        if one_word(word) and text.startswith(self.lead) and not (self.folds_case and word.lower() != word):
            return token_bytes([token.id for token in self.tokenize(byte_symbols(text))])
        return token_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


# Pre-split of printable ASCII text without white space inside: lower case with single digits for the vocabulary
# that folds case, and behind at most one space for the byte-level one. The contractions.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_MARKS = r"!-/:-@\[-`{-~"
_FOLDED = re.compile(rf"{_CONTRACTIONS}|[a-z]+|[0-9]|[{_ASCII_MARKS}]+")
_SPACED = re.compile(rf"{_CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[{_ASCII_MARKS}]+")
_SPACE_SYMBOL = chr(BYTE_SYMBOLS[32])


#: Marks that close a word; behind a Latin letter or a digit they always start a new piece.
_MARKS = ".,!?;:"
_LATIN_END = "ɐ"

#: Words that ``LetterTable`` encodes at once.
_TOGETHER = 1000

# Letters of Latin-1 but its two ordinal signs and the micro sign: each stands for itself when composed.
_LATIN_1 = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªºµ")
_LETTERS_AND_MARKS = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{_MARKS}]*$"
_SYMBOLS_OF_LINES = {**BYTE_SYMBOLS, ord("\n"): "\n"}


def _split_marks(piece: str) -> tuple[str, str] | None:
    core = piece.rstrip(_MARKS)
    if core and len(core) < len(piece) and core[-1] < _LATIN_END and core[-1].isalnum():
        return core, piece[len(core) :]
    return None


class WordTable(Bounded):
    """What ``encode`` gives for words between ASCII white space, for a vocabulary that drops white
    space and case. Values of a word and the marks behind it add up."""

    def __init__(self, encode: Callable, limit: int = TABLE_BYTES):
        super().__init__(limit)
        self.encode = encode

    def __missing__(self, word: bytes):
        value = self.older.get(word)
        if value is not None:
            return self.store(word, value)
        lower = word.lower()
        if lower.isalpha():  # ASCII letters
            return self.store(word, self.encode(word.decode())) if lower == word else self._sum(word, (lower,))
        text = word.decode()
        if "<|" in text:
            return self.store(word, self.encode(text))
        if text.isascii() and text.isprintable():
            parts = _FOLDED.findall(lower.decode())
            if len(parts) > 1:
                return self._sum(word, [part.encode() for part in parts])
            return self.store(word, self.encode(lower.decode())) if lower == word else self._sum(word, (lower,))
        folded = text.lower()
        if max(folded) < _LATIN_END and (parts := _split_marks(folded)):
            return self._sum(word, [part.encode() for part in parts])
        return self.store(word, self.encode(folded if max(folded) < _LATIN_END else text))

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of whole texts (null: empty) for a ``PieceEncoder``. Every word of a slice is looked up once."""
        words = pc.ascii_split_whitespace(column.fill_null(""))
        coded = words.flatten().dictionary_encode()
        return joined(self.values(coded.dictionary), coded.indices, words.offsets.to_numpy())

    def values(self, words: pa.Array) -> pa.Array:
        """Ids of words. Words of letters are looked up without their case and marks."""
        plain, core, marks = letters_and_marks(words)
        core = pc.utf8_lower(core).dictionary_encode()
        found = self.letters(core.dictionary).take(core.indices)
        of_marks, others = (list(map(self.__getitem__, utf8(x))) for x in (marks.dictionary, words.filter(pa.array(~plain))))
        return in_parts(plain, found, marks, of_marks, others)

    @cached_property
    def letters(self) -> LetterTable:
        return LetterTable(self.encode.tokenizer.model, "", self.limit // 4)

    def _sum(self, word: bytes, parts):
        """The sum of the parts' values. It is stored only if all parts were known, as a rare word is rarer still
        in a variant."""
        known = all([part in self for part in parts])
        first, *rest = map(self.__getitem__, parts)
        for value in rest:
            first = first + value
        return self.store(word, first) if known else first


class _Spaced(Bounded):
    """Ids of pieces behind one space. None where the piece cannot be told from what follows."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, limit: int):
        super().__init__(limit)
        self.encode, self.lead = encode, lead
        self.bare = Bounded(limit // 4)

    def __missing__(self, piece: str):
        if not piece or piece[-1].isspace():
            return None
        value = self.older.get(piece)
        return self.store(piece, self._find(piece) if value is None else value)

    def _find(self, piece: str) -> bytes:
        line = piece.find("\n")
        if line > 0 and not piece[line - 1].isspace():
            return self[piece[:line]] + self._bare(piece[line:])
        parts = None if "<|" in piece else _split_marks(piece)
        return self[parts[0]] + self._bare(parts[1]) if parts else self.encode(self.lead + piece)

    def _bare(self, piece: str) -> bytes:
        """Ids of a piece that has no space in front: marks, or a line end and what follows."""
        value = self.bare.get(piece)
        return self.bare.store(piece, self._find_bare(piece)) if value is None else value

    def _find_bare(self, piece: str) -> bytes:
        if "<|" not in piece:
            if piece[0] == "\n" and len(piece) > 1 and not piece[1].isspace():  # a single line end is a piece
                return self._bare("\n") + self._bare(piece[1:])
            if parts := _split_marks(piece):
                return self._bare(parts[0]) + self._bare(parts[1])
        return self.encode(piece)


class SpacedTexts:
    """Ids of whole texts for a byte-level vocabulary whose pre-split keeps a space with the word
    behind it.

    A text may be cut in front of a space that follows anything but white space: no match of the
    split pattern goes across. Pieces between such spaces are encoded once and looked up from then
    on; pieces that end in white space are joined with the next one first.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = TABLE_BYTES):
        self.encode, self.limit = encode, limit
        self.inner = _Spaced(encode, " ", limit)
        self.first = _Spaced(encode, "", limit // 16 + 1)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return b"".join([self.first[first], *map(self.inner.__getitem__, rest)])
        except TypeError:  # some piece is empty or ends in white space
            return self._ids_joined(first, rest)

    def texts(self, column: pa.Array) -> list[bytes]:
        """``ids`` of whole texts (null: empty). Every piece of a slice is looked up once."""
        column = column.fill_null("")
        pieces = Pieces(column)
        begins = pieces.bounds[:-1]
        codes = np.delete(pieces.codes, begins)
        used = np.unique(codes)
        values = self.behind_space(pieces.distinct.take(pa.array(used)))
        out = pieces.joined(values, np.searchsorted(used, codes), pieces.bounds - np.arange(len(pieces.bounds)))
        firsts = pieces.distinct.take(pa.array(pieces.codes[begins])).to_pylist()
        for i, first in enumerate(map(self.first.__getitem__, firsts)):
            out[i] = self.ids(column[i].as_py()) if first is None or out[i] is None else first + out[i]
        return out

    def behind_space(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces behind one space, null where a piece cannot be told from what follows."""
        plain, core, marks = letters_and_marks(pieces)
        core = core.dictionary_encode()
        found = self.letters(core.dictionary).take(core.indices)
        of_marks = [self.inner._bare(m) if m else b"" for m in marks.dictionary.to_pylist()]
        others = list(map(self.inner.__getitem__, pieces.filter(pa.array(~plain)).to_pylist()))
        return in_parts(plain, found, marks, of_marks, others)

    @cached_property
    def letters(self) -> LetterTable:
        return LetterTable(self.encode.tokenizer.model, " ", self.limit // 4)

    def _ids_joined(self, first: str, rest: list[str]) -> bytes:
        out, held = [], first
        for piece in rest:
            if not held or held[-1].isspace():
                held += " " + piece
            else:
                out.append(self._one(held, not out))
                held = piece
        out.append(self._one(held, not out))
        return b"".join(out)

    def _one(self, piece: str, first: bool) -> bytes:
        known = None if first else self.inner[piece]
        return self.encode(piece if first else " " + piece) if known is None else known
