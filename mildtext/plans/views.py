"""Pairs, inputs, lexicons and predictions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.rewrite import delete_each, delete_inline
from mildtext.sources import pairs as ps

LANGS = ("de", "en", "es", "fr")
# Terms that occur in the texts, for every language of the tables.
TERMS = ("idiot", "stupid", "moron", "loser", "pathetic", "trash", "worthless", "disgusting", "scum")
# One more term and three stems, so that matching by prefix has work.
EXTRA_TERMS = ("clown", "tion", "ent", "ered")
WIDER_TERMS = (*TERMS, "clown", "ered")
# Extra terms for a language with and one without a built-in list.
AUGMENTED_TERMS = {"de": ["keit"], "fr": ["clown", "eaux"], "en": ["ered"]}
JUDGE_TERMS = (*TERMS, *EXTRA_TERMS)
# Stems first, so that every step of the series by lexicon size changes the rewrites.
SERIES_TERMS = ("tion", "idiot", "ered", "stupid", "clown", "moron", "loser", "pathetic", "trash",
                "worthless", "disgusting", "scum")
SERIES_SIZES = (2, 4, 12)
SERIES_METHODS = ("exact", "prefix")


def per_language(terms: tuple[str, ...]) -> dict[str, list[str]]:
    return {lang: list(terms) for lang in LANGS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as its files lie."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of the following id as its counterpart; without one, with a blank.

    Loading drops pairs with a blank side, so a gap in the ids shows as such and loses no row unseen.
    """
    docs = table(spark, sf_dir, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("neutral_sentence"))
    pairs = docs.select(F.col("doc_id").alias("pair_id"), "lang", F.col("text").alias("toxic_sentence"))
    return pairs.join(following, "pair_id", "left").fillna("", ["neutral_sentence"])


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows; columns as in a converted-text source."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("Original Text")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Converted_Text")
    )
    # joined on both columns, so a very long conversation is no hot key
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("pair_id"),
        F.lit("en").alias("lang"),
        "Original Text",
        "Converted_Text",
    )


def extra_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second copy of the Spanish pairs under other column names."""
    return (
        doc_pairs(spark, sf_dir)
        .filter(F.col("lang") == "es")
        .withColumnsRenamed({"toxic_sentence": "original", "neutral_sentence": "detoxified"})
    )


def pair_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The three sources in order of priority."""
    return [
        ps.normalize_pairs(conv_pairs(spark, sf_dir), "converted", 0, ps.CONVERTED_COLUMNS),
        ps.normalize_pairs(doc_pairs(spark, sf_dir), "parallel", 1, ps.PARALLEL_COLUMNS),
        ps.normalize_pairs(extra_pairs(spark, sf_dir), "extra", 2, ps.EXTRA_COLUMNS),
    ]


def raw_pair_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same before blank rows are dropped, and system turns, whose counterpart is blank."""
    lang = F.col("lang")
    sources = [
        ps.normalize_pairs_keep_blank(conv_pairs(spark, sf_dir), "converted", 0, ps.CONVERTED_COLUMNS, lang),
        ps.normalize_pairs_keep_blank(doc_pairs(spark, sf_dir), "parallel", 1, ps.PARALLEL_COLUMNS, lang),
        ps.normalize_pairs_keep_blank(extra_pairs(spark, sf_dir), "extra", 2, ps.EXTRA_COLUMNS, lang),
    ]
    system = table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
    unanswered = system.select(
        (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("pair_id"),
        F.lit("en").alias("lang"),
        F.col("text").alias("toxic"),
        F.lit(" \t\n").alias("neutral"),
    )
    sources.append(
        ps.normalize_pairs_keep_blank(unanswered, "unanswered", 3, ps.EXTRA_COLUMNS, lang)
    )
    return sources


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large raw lexicon: every word of the benchmark texts, not yet cleaned."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.lit("en").alias("lang"), F.explode(tx.words(F.col("text"))).alias("word"))


def toxic_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic."""
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    docs = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("row_id"), "lang", "text")


def all_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as inputs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang", "text")


def predictions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Rewrites of inputs, the toxic ones by default, by three experiments, with references; one pass over the texts."""
    rows = toxic_inputs(spark, sf_dir) if rows is None else rows
    rows = delete_each(
        rows,
        {
            "neutral": (per_language(JUDGE_TERMS), "prefix"),
            "by_exact": (per_language(TERMS), "exact"),
            "by_prefix": (per_language(WIDER_TERMS), "prefix"),
        },
    )
    return rows.select(
        "row_id",
        "lang",
        F.col("text").alias("toxic"),
        "neutral",
        F.explode(
            F.array(
                F.struct(F.lit("identity").alias("experiment"), F.col("text").alias("prediction")),
                F.struct(F.lit("delete_exact").alias("experiment"), F.col("by_exact").alias("prediction")),
                F.struct(F.lit("delete_prefix").alias("experiment"), F.col("by_prefix").alias("prediction")),
            )
        ).alias("run"),
    ).select("row_id", "lang", "toxic", "neutral", "run.*")


def series_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites by method and lexicon size (``exact_2`` ... ``prefix_12``), and ``identity``."""
    rows = toxic_inputs(spark, sf_dir)
    runs = [F.struct(F.lit("identity").alias("experiment"), F.col("text").alias("prediction"))]
    for method in SERIES_METHODS:
        for size in SERIES_SIZES:
            name = f"{method}_{size}"
            rows = delete_inline(rows, per_language(SERIES_TERMS[:size]), method, out=name)
            runs.append(F.struct(F.lit(name).alias("experiment"), F.col(name).alias("prediction")))
    return rows.select(
        "row_id", "lang", F.col("text").alias("toxic"), F.explode(F.array(*runs)).alias("run")
    ).select("row_id", "lang", "toxic", "run.*")
