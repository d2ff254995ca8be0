"""From raw documents to packed sequences: the stages of a training corpus.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last
one the packed pieces.  A stage's result is written as parquet and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.llm import bpe, jaccard, packing, secrets, substring, toxicity
from mildtext.llm.common import read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, the number of characters as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon does not reject."""
    docs = docs.select(*COLUMNS)
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles are at least 80% alike."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 35 words that occur elsewhere too; what is left of a text, be it empty, stays."""
    return _counted(substring.remove(docs.select(*COLUMNS)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kind of each secret in its place."""
    return _counted(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2,048 tokens."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(docs, vocabulary, 2048), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# Learned weights and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
