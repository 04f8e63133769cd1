"""From raw documents to packed training sequences, in stages.

Each stage gets what the one before kept and returns the columns of documents; the last returns the
packed pieces. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import packing, quality, simhash, substring
from tallyworks.llm.queries import WORD_VOCABULARY
from tallyworks.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Token behind every document.
END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them. Null, empty and blank texts are
    rejected; rows with null or repeated ids are judged each on its own; an empty table stays empty."""
    kept = quality.judge(docs.select(COLUMNS)).filter("kept").withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: fingerprints of three-word shingles, linked
    at two differing bits or fewer. Null, empty and blank texts are copies of each other. Documents without an
    id stay; of rows that share an id only those go whose text has an earlier copy. An empty table stays empty."""
    return simhash.without_copies(docs.select(COLUMNS), shingle=3, most=2).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without a word go.
    Texts that lose nothing keep their white space. Rows with null or repeated ids are documents of their
    own; null, empty and blank texts have no word and go; an empty table stays empty."""
    cut = substring.remove_repeats(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.filter("n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids. A null or empty text is packed as its end token; rows
    with null or repeated ids are documents of their own; an empty table gives no piece."""
    with open(WORD_VOCABULARY, encoding="utf-8") as file:
        return packing.pack(docs, file.read(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack_sequences),
]

#: Line rules, fingerprints and a tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
