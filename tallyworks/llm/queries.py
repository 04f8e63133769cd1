"""Registered queries of the operators: whole tables in, digests of the operators' results out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import (
    alignment,
    bpe,
    chat,
    licenses,
    lm_scoring,
    packing,
    prefix_trie,
    quality,
    simhash,
    substring,
    token_counts,
    token_files,
    topk,
)

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Ids that the word vocabulary has for the begin and the end of a text.
TEXT_BEGIN, TEXT_END = 49406, 49407

#: Tokens beyond which a text counts as over the limit.
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _tokens(ids: str):
    return (F.octet_length(ids) / 4).cast("long")


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lost_words",
        "base_failed",
        "kept",
    )


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).select(
        "doc_id", "n_sentences", "n_known", "sequence", "licenses"
    )


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    added = spark.createDataFrame(extra, "conv_id long, turn int, role string, text string")
    stored = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = stored.unionByName(added).withColumn("parts", chat.text_parts(F.col("text")))
    output = chat.format_chats(turns).withColumn("formatted", chat.formatted())
    read = output.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss().alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).drop("text_key")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), _vocabulary(WORD_VOCABULARY), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues"
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, folder, "documents"), _vocabulary(WORD_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    files = token_files.write_files(documents, _vocabulary(BYTE_VOCABULARY), 0, token_files.new_folder(spark))
    return token_files.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), _vocabulary(WORD_VOCABULARY)).select(
        "doc_id",
        _tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_substring(spark: SparkSession, folder: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))


def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(_table(spark, folder, "documents"), _vocabulary(WORD_VOCABULARY), TEXT_BEGIN, TEXT_END)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    with open(PIECE_MODEL, "rb") as file:
        model = file.read()
    documents = _table(spark, folder, "documents")
    return alignment.linked(documents, _vocabulary(BYTE_VOCABULARY), model, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk,
        op2_quality,
        op3_licenses,
        op4_chat,
        op5_simhash,
        op6_packing,
        op7_token_counts,
        op8_token_files,
        op9_bpe,
        op10_substring,
        op11_prefix_trie,
        op12_lm_scoring,
        op13_alignment,
    )
}
