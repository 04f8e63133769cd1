"""Log probabilities of texts under a word unigram and a causal self-attention model, both learnt from the corpus.

Words are counted over all training texts. The most frequent ones, a fixed number of rows, are sent to all
tasks; the other words of a text meet their counts in a join. Texts are encoded once; the counts of the tokens, by which the
attention model (``attention.py``) orders them, are taken from the encoded texts.

The attention model learns from all training texts, in rounds: in a round trainers, one for every ``TRAINER_TOKENS``
tokens, start from the same weights, each goes through its texts once, and the weights are averaged in Spark; only the
average, of fixed size, meets the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm import attention
from tallyworks.llm.texts import PieceEncoder, WordTable, joined, kept, slices
from tallyworks.session import materialise

#: Rows of the broadcast table of words; longer words than LONG_WORD bytes go by a digest.
HEAD_WORDS = 1 << 17
LONG_WORD = 40

#: The end of a text; no word is empty.
END = b""

#: Tokens of a trainer. What one trainer can learn it goes through in every round; a larger corpus is dealt out to
#: the rounds, so that from ROUNDS trainers on every text is learnt from once.
TRAINER_TOKENS = 1 << 19
ROUNDS = 4
RATES = (0.01, 0.01, 0.005, 0.002)

#: Weights are averaged as integers, so that the order of the sum does not matter.
_FIXED = 1 << 24

_CODED = (
    "doc_id long, held_out boolean, drawn long, n_tokens long, n_known long, base double, "
    "tail array<struct<word:binary,times:long>>, ids binary"
)
_CODED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("drawn", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("tail", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))),
        ("ids", pa.binary()),
    ]
)


def held_out() -> Column:
    """Whether a document is kept out of training: crc32 of its decimal id (null: empty) modulo 10 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Words:
    """Words of lower-case texts without nulls: the distinct ones, their codes in order, and where a text's codes start and end.
    White space at the start or end of a text leaves empty words."""

    def __init__(self, lowered: pa.Array):
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        self.distinct, self.codes, self.bounds = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()
        self.sizes = pc.binary_length(self.distinct).to_numpy()


def words(lowered: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same without the empty words."""
    found = Words(lowered)
    real = found.sizes[found.codes] > 0
    return found.distinct.cast(pa.binary()), found.codes[real], np.concatenate(([0], np.cumsum(real)))[found.bounds]


def lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(column.fill_null(""))


def key_of(word: bytes) -> bytes:
    """The word, or a digest behind a space (which no word holds) if it is long."""
    return word if len(word) <= LONG_WORD else b" " + hashlib.blake2b(word, digest_size=16).digest()


def keys_of(distinct: pa.Array) -> pa.Array:
    long = pc.greater(pc.binary_length(distinct), LONG_WORD)
    return pc.replace_with_mask(distinct, long, pa.array(map(key_of, distinct.filter(long).to_pylist()), pa.binary()))


class Encoder:
    """Token ids of words by a vocabulary that drops white space and case."""

    def __init__(self, tokenizer_json: str):
        self.table = WordTable(PieceEncoder(tokenizer_json))
        self.size = self.table.encode.tokenizer.get_vocab_size(with_added_tokens=True)

        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")  # of the ids that are kept

    def __call__(self, words: pa.Array) -> pa.Array:
        """Ids of words, as they are kept."""
        coded = self.table.values(words)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(coded).to_numpy(), dtype=np.int64))) >> 2
        first = int(np.frombuffer(coded.buffers()[1], np.int64)[coded.offset]) if len(coded) else 0
        ids = np.frombuffer(coded.buffers()[2] or b"", "<u4", int(ends[-1]), first).astype(self.kind)
        return pa.Array.from_buffers(pa.large_binary(), len(coded), [None, pa.py_buffer(self.kind.itemsize * ends), pa.py_buffer(ids)])


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): counts over the training texts of ``docs``. Every text ends in one ``END``."""

    def run(batches):
        for batch in slices(batches):
            distinct, codes, _ = words(lowered(batch.column("text")))
            times = np.bincount(codes, minlength=len(distinct))
            found = pa.concat_arrays([keys_of(distinct.filter(pa.array(times > 0))), pa.array([END], pa.binary())])
            times = np.append(times[times > 0], batch.num_rows)
            yield pa.RecordBatch.from_arrays([found, pa.array(times, pa.int64())], names=["word", "n"])

    rows = docs.filter(~held_out()).select("text").mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def token_counts(coded: DataFrame, size: int, kind: np.dtype) -> DataFrame:
    """``token`` and ``n`` over all training texts of ``coded`` (held_out, ids), without their ends; at most a row for each of
    the ``size`` vocabulary entries."""

    def run(batches):
        sums = np.zeros(size, np.int64)
        for batch in slices(batches, "ids"):
            sums += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=size)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["token", "n"])

    rows = coded.filter(~F.col("held_out")).select("ids").mapInArrow(run, "token int, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def train(coded: DataFrame, counts: np.ndarray, kind: np.dtype, begin: int, end: int) -> np.ndarray:
    """Weights of the attention model, learnt from all texts of ``coded`` (held_out, drawn, ids as ``kind``) that are not held out;
    ``counts``: of their tokens by id. ``drawn``, a hash, deals the texts to rounds and trainers.
    """
    session = coded.sparkSession
    vocabulary = attention.Vocabulary(counts)
    weights = attention.start(vocabulary)
    trainers = max(1, math.ceil(int(counts.sum()) / TRAINER_TOKENS))
    parts = max(1, min(ROUNDS, trainers))
    texts = coded.filter(~F.col("held_out")).select("drawn", "ids")
    for round_number in range(ROUNDS):
        given = session.sparkContext.broadcast((attention.flatten(weights), vocabulary.place))  # fixed size
        part = texts.filter(F.col("drawn") % parts == round_number % parts)
        dealt = part.repartition(math.ceil(trainers / parts), "drawn").sortWithinPartitions("drawn", "ids")
        rate = RATES[round_number]

        def learn(batches, given=given, rate=rate):
            flat, place = given.value
            trainer = attention.Trainer(attention.unflatten(flat), rate)
            texts, rows = [], 0
            for batch in slices(batches, "ids"):
                for data in batch.column("ids").to_pylist():
                    texts.append(place[np.frombuffer(data, kind)])
                    rows += len(texts[-1]) // attention.STEP + 1
                    if rows >= attention.TRAIN_WINDOWS:
                        _learn(trainer, texts, place, begin, end)
                        texts, rows = [], 0
            if texts:
                _learn(trainer, texts, place, begin, end)
            if trainer.steps:
                fixed = np.round(attention.flatten(trainer.weights).astype(np.float64) * _FIXED).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([fixed.tolist()], pa.list_(pa.int64()))], names=["weights"])

        learnt = materialise(dealt.select("ids").mapInArrow(learn, "weights array<long>"), "lm-weights")
        weights = _averaged(learnt, weights)
    return attention.flatten(weights)


def _averaged(learnt: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean of the trainers' weights, summed in rounds of partial sums; the driver gets a few rows."""

    def add(batches):
        total, number = None, 0
        for batch in batches:
            for row, n in zip(batch.column("weights"), batch.column("n").to_pylist()):
                values = row.values.to_numpy()
                total = values.copy() if total is None else total + values
                number += n
        if number:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([number], pa.int64())], names=["weights", "n"])

    sums, rows = learnt.withColumn("n", F.lit(1).cast("long")), learnt.count()
    while rows > 8:
        rows = -(-rows // 8)
        sums = materialise(sums.repartition(rows).mapInArrow(add, "weights array<long>, n long"), "lm-sums")
    parts = sums.collect()  # eight rows at most
    if not parts:
        return weights
    total = np.sum([np.array(r.weights, np.int64) for r in parts], axis=0)
    return attention.unflatten(total / sum(r.n for r in parts) / _FIXED)


def _learn(trainer, texts: list[np.ndarray], place: np.ndarray, begin: int, end: int) -> None:
    inputs, targets, rows = attention.windows(texts, int(place[begin]), int(place[end]))
    for low in range(0, len(rows), attention.TRAIN_WINDOWS):
        trainer.learn(inputs, targets, rows[low : low + attention.TRAIN_WINDOWS])


class TextScorer:
    """Log10 probabilities of texts, given as token ids, under trained weights."""

    def __init__(self, counts: np.ndarray, flat: np.ndarray, begin: int, end: int):
        self.begin, self.end = begin, end
        self.vocabulary = attention.Vocabulary(counts)
        self.scorer = attention.Scorer(attention.unflatten(flat))

    def __call__(self, ids: list[np.ndarray]) -> np.ndarray:
        place, inside = self.vocabulary.place, self.vocabulary.inside
        placed = [place[x] for x in ids]
        inputs, targets, rows = attention.windows(placed, int(place[self.begin]), int(place[self.end]))
        logs = self.scorer(inputs, targets, rows)
        begins = np.cumsum([0, *(len(x) + 1 for x in ids)])[:-1]
        sums = np.add.reduceat(logs, begins) + [inside[x].sum() + inside[self.end] for x in ids]
        return sums / math.log(10)


class Coder:
    """Rows of ``_CODED`` for batches of texts: ids of their tokens, logs of their frequent words, counts of the others."""

    def __init__(self, encoder: Encoder, head: pa.Table, divisor: float):
        self.encoder = encoder
        self.head = head["word"].combine_chunks().cast(pa.binary())
        self.logs = np.append(np.log10((head["n"].to_numpy() + 0.1) / divisor), math.nan)
        at_end = self.head.index(pa.scalar(END, pa.binary())).as_py()
        self.end = [float(self.logs[at_end])] if at_end >= 0 else []

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        found, number = Words(lowered(batch.column("text"))), batch.num_rows
        ids = joined(self.encoder(found.distinct), pa.array(found.codes), found.bounds)
        text = np.repeat(np.arange(number), np.diff(found.bounds))
        real = found.sizes[found.codes] > 0
        codes, text = found.codes[real], text[real]
        sizes = np.bincount(text, minlength=number)
        keys = keys_of(found.distinct.cast(pa.binary()))
        at = pc.index_in(keys, value_set=self.head).fill_null(len(self.head)).to_numpy()
        new = (at == len(self.head))[codes]
        logs, known = self.logs[at[codes[~new]]].tolist(), np.bincount(text[~new], minlength=number)
        ends = np.cumsum(known).tolist()
        base = [math.fsum(logs[low:high] + self.end) for low, high in zip([0, *ends], ends)]
        tail = self._tail(keys, codes[new], text[new], number)
        columns = [*(batch.column(n) for n in ("doc_id", "held_out", "drawn")), sizes + 1, known + len(self.end), base, tail, ids]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, _CODED_ARROW)], schema=_CODED_ARROW)

    def _tail(self, keys: pa.Array, codes: np.ndarray, text: np.ndarray, number: int) -> pa.Array:
        """For every text the words outside the head and how often they occur."""
        kinds = len(keys) + 1  # the last one: the end of a text
        pairs = text * kinds + codes
        if not self.end:
            pairs = np.concatenate((pairs, np.arange(number) * kinds + kinds - 1))
        pairs, times = np.unique(pairs, return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(number + 1) * kinds)
        named = pa.concat_arrays([keys, pa.array([END], pa.binary())]).take(pa.array(pairs % kinds))
        rows = pa.StructArray.from_arrays([named, pa.array(times, pa.int64())], fields=list(_CODED_ARROW.field("tail").type.value_type))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows, type=_CODED_ARROW.field("tail").type)


def score(docs: DataFrame, tokenizer_json: str, begin: int, end: int, head_words: int = HEAD_WORDS) -> DataFrame:
    """Log10 probabilities of all texts of ``docs`` (doc_id, text; other columns are ignored).

    Result: ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (unigram with 0.1 added to every count and one place for the unseen) and
    ``score`` (attention model over the vocabulary's tokens, ``begin`` in front and ``end`` behind the text).

    A null or empty text has only its end. A null id counts as an empty string in the choice of held-out texts.
    Every row is scored on its own, repeated rows and ids too, and counts once for each. Without training texts all
    tokens are unseen. An empty table has no rows.
    """
    session = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long"), "text")
    table = materialise(word_counts(named), "lm-words")
    number, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    divisor = number + 0.1 * (distinct + 1)
    top = table.orderBy(F.desc("n"), "word").limit(head_words).toArrow()  # a fixed number of rows at most
    shared = session.sparkContext.broadcast((tokenizer_json, top))  # one vocabulary file, a fixed number of rows
    unseen = math.log10(0.1 / divisor)

    def run(batches):
        tokenizer, head = shared.value
        coder = Coder(kept(Encoder, tokenizer), head, divisor)
        for batch in slices(batches, limit=1 << 22):
            yield coder(batch)

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("drawn")
    coded = named.select("doc_id", held_out().alias("held_out"), drawn, "text").mapInArrow(run, _CODED)
    coded = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "lm-coded", compression="zstd")
    encoder = kept(Encoder, tokenizer_json)
    size, kind = encoder.size, encoder.kind
    by_token = token_counts(coded, size, kind).toArrow()  # a row for each vocabulary entry at most
    of_token = np.zeros(size, np.int64)
    of_token[by_token["token"].to_numpy()] = by_token["n"].to_numpy()
    ends = table.filter(F.col("word") == F.lit(END)).select("n").first()
    of_token[end] += ends["n"] if ends else 0
    given = session.sparkContext.broadcast((of_token, train(coded, of_token, kind, begin, end)))  # fixed size

    def scores(batches):
        scorer = TextScorer(*given.value, begin, end)
        for batch in slices(batches, "ids", limit=1 << 19):
            found = scorer([np.frombuffer(data, kind) for data in batch.column("ids").to_pylist()])
            arrays = [pa.array(found) if n == "score" else batch.column(n) for n in plain]
            yield pa.RecordBatch.from_arrays(arrays, names=plain)

    plain = ["row", "doc_id", "held_out", "n_tokens", "score", "n_known", "base"]
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, score double, n_known long, base double"
    found = coded.select(*(n for n in plain if n != "score"), "ids").mapInArrow(scores, kinds)
    names = ["doc_id", "held_out", "n_tokens", "score"]
    rest = coded.select("row", F.inline("tail").alias("word", "times")).join(table, "word", "left")
    log = F.log10((F.col("n") + 0.1) / divisor)
    sums = rest.select(
        "row",
        *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in names),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.coalesce(log, F.lit(unseen))).alias("base"),
    )
    both = found.select("row", *names, "n_known", "base").unionByName(sums)
    grouped = both.groupBy("row").agg(*(F.max(n).alias(n) for n in names), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"))
    return grouped.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(number).cast("long").alias("train_tokens"), "base_score", "score"
    )
