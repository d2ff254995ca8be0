"""Cleaning of pairs: union, length ratio, dedup, counts, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.later import later_rows
from mildtext.operators.once import once
from mildtext.session import materialize, shared


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of several pair sources; ``source_rank`` keeps their priority."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other)
    return merged


def with_word_counts(pairs: DataFrame) -> DataFrame:
    return once(
        pairs, n_toxic=tx.word_count(F.col("toxic")), n_neutral=tx.word_count(F.col("neutral"))
    )


def length_ratio() -> Column:
    """Longer over shorter side in words; the divisor is at least one."""
    a, b = F.col("n_toxic"), F.col("n_neutral")
    return F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))


def filled() -> Column:
    """Both sides have a word, which is the same as: neither is blank."""
    return (F.col("n_toxic") > 0) & (F.col("n_neutral") > 0)


def length_ratio_filter(pairs: DataFrame, limit: float = 3.0) -> DataFrame:
    """Keep filled pairs whose ratio is at most ``limit``; adds the word counts."""
    return with_word_counts(pairs).filter(filled() & (length_ratio() <= limit))


PAIR_IDS = ["source_rank", "pair_id"]


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """One row per language and exact pair: that of the first source, then of the lowest id."""
    return dedup_with_keys(pairs)[0]


def dedup_with_keys(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`dedup_pairs`, and ``lang`` with the ids of what it keeps.

    The pairs are written with their digest, so that whatever makes them, patterns over both texts
    and joins, runs once.  Later passes read the columns they need: the copies come out of one
    sorted stream of language, digest and ids (:func:`later_rows`), and leave the texts where they
    are: broadcast if their measured size is small.  ``source_rank`` and ``pair_id`` name a row, as everywhere
    in the preparation.
    """
    hashed = materialize(pairs.withColumn("pair_hash", tx.pair_hash(F.col("toxic"), F.col("neutral"))))
    ids = hashed.select("lang", "pair_hash", *PAIR_IDS)
    copies = shared(later_rows(ids, ["lang", "pair_hash"], PAIR_IDS).distinct())
    kept = ids.select("lang", *PAIR_IDS).join(copies, PAIR_IDS, "left_anti")
    return hashed.join(copies, PAIR_IDS, "left_anti"), kept


def preprocess_pairs(pairs: DataFrame, limit: float = 3.0) -> DataFrame:
    """Drop blank pairs, then pairs of unlike length, then copies."""
    return dedup_pairs(length_ratio_filter(pairs, limit))


def preprocess_with_keys(pairs: DataFrame, limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """:func:`preprocess_pairs`, and ``lang`` with the ids of what it keeps."""
    return dedup_with_keys(length_ratio_filter(pairs, limit))


def preprocess_funnel(pairs: DataFrame, limit: float = 3.0) -> DataFrame:
    """Per language: rows in, dropped as blank, by length, as copies, and rows left.

    Copies are counted per distinct pair first, so only (language, hash, count)
    is shuffled and a hot pair is one partial row per task.
    """
    kept = filled() & (length_ratio() <= limit)
    per_pair = (
        with_word_counts(pairs)
        .select(
            "lang",
            F.when(kept, tx.pair_hash(F.col("toxic"), F.col("neutral")))
            .when(filled(), F.lit("length"))
            .otherwise(F.lit("blank"))
            .alias("key"),
        )
        .groupBy("lang", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n, key = F.col("n"), F.col("key")
    dropped = key.isin("length", "blank")

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")

    return per_pair.groupBy("lang").agg(
        F.sum("n").cast("bigint").alias("n_orig"),
        total(key == "blank").alias("n_empty"),
        total(key == "length").alias("n_length"),
        total(~dropped, n - 1).alias("n_dup"),
        total(~dropped, F.lit(1)).alias("n_final"),
    )


def data_summary(rows: DataFrame, kind: str = "pairs", *by: str) -> DataFrame:
    """Number of rows per language and split, in order."""
    keys = list(by) or ["lang", "split"]
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.lit(kind))
        .orderBy(*keys)
    )


def split_preview(rows: DataFrame, chars: int = 100) -> DataFrame:
    """First pair of each language and split, with the start of both texts.

    Only ids are ranked; the texts are cut to the preview before they move.
    """
    return (
        rows.groupBy("lang", "split")
        .agg(
            F.min_by(
                F.struct(
                    "pair_id",
                    F.substring("toxic", 1, chars).alias("toxic"),
                    F.substring("neutral", 1, chars).alias("neutral"),
                ),
                "pair_id",
            ).alias("first")
        )
        .select(
            "lang",
            "split",
            F.col("first.pair_id").alias("pair_id"),
            F.col("first.toxic").alias("toxic_start"),
            F.col("first.neutral").alias("neutral_start"),
        )
    )
