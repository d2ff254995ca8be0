"""Fixed-length token ids of pairs, as columns for a training job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.once import once

PAD, END, FIRST = 0, 1, 2  # ids 0 and 1 are reserved
IGNORE = -100  # fixed value: label of padding
VOCABULARY = 32_000


def hashed_ids(c: Column, limit: int, vocabulary: int = VOCABULARY) -> Column:
    """Default tokenizer: one id per white-space word, out of its digest, for ``limit`` words."""
    return F.transform(
        tx.first_words(c, limit),
        lambda w: (
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % (vocabulary - FIRST) + FIRST
        ).cast("int"),
    )


def close_and_cut(ids: Column, max_length: int) -> Column:
    """At most ``max_length`` ids, the last of them the end mark."""
    return F.concat(F.slice(ids, 1, max_length - 1), F.array(F.lit(END)))


def pad(ids: Column, max_length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), max_length - F.size(ids)))


def attention(ids: Column, max_length: int) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), max_length - F.size(ids))
    )


def mask_padding(padded: Column) -> Column:
    return F.transform(padded, lambda t: F.when(t == PAD, F.lit(IGNORE)).otherwise(t))


def tokenize_inputs(df: DataFrame, text: str = "text", max_length: int = 128,
                    prefix: str = "detoxify: ", tokenizer=hashed_ids) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` of ``prefix + text``, both ``max_length`` long.

    ``tokenizer`` maps a string column and a limit to an array of ids; an outside
    tokenizer plugs in as a pandas UDF.
    """
    asked = F.concat(F.lit(prefix), F.col(text))
    return _with_masks(once(df, ids=close_and_cut(tokenizer(asked, max_length - 1), max_length)), max_length)


def _with_masks(cut: DataFrame, max_length: int) -> DataFrame:
    return (
        cut.withColumn("input_ids", pad(F.col("ids"), max_length))
        .withColumn("attention_mask", attention(F.col("ids"), max_length))
        .drop("ids")
    )


def tokenize_pairs(df: DataFrame, toxic: str = "toxic", neutral: str = "neutral",
                   max_length: int = 128, prefix: str = "detoxify: ", tokenizer=hashed_ids) -> DataFrame:
    """As :func:`tokenize_inputs`, plus ``labels``: the ids of the neutral side, padding ignored."""
    asked = F.concat(F.lit(prefix), F.col(toxic))
    cut = once(
        df,
        ids=close_and_cut(tokenizer(asked, max_length - 1), max_length),
        target=close_and_cut(tokenizer(F.col(neutral), max_length - 1), max_length),
    )
    masked = mask_padding(pad(F.col("target"), max_length))
    return _with_masks(cut.withColumn("labels", masked), max_length).drop("target")


def save_tokenized(rows: DataFrame, path: str) -> None:
    """Parquet in a folder per language and split; saving some of them again leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "split").parquet(path)


def load_tokenized(spark: SparkSession, path: str, lang: str | None = None, split: str | None = None) -> DataFrame:
    """A saved dataset, or the part of a language or split: only its folders are read."""
    rows = spark.read.parquet(path)
    for name, value in (("lang", lang), ("split", split)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows
