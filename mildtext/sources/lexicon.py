"""Lexicons: shape ``lang, term``, lower-case, stripped, distinct."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.functions.terms import BUILTIN_TERMS
from mildtext.sources.pairs import pick

# Names of the term column, in the order they are tried.
TERM_COLUMNS = ("word", "term", "text")
LEXICON_SCHEMA = "lang string, term string"


def lexicon_from_terms(spark: SparkSession, terms: Mapping[str, Iterable[str]]) -> DataFrame:
    """A lexicon from lists in the program."""
    rows = sorted({(lang, term) for lang, group in terms.items() for term in group})
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def builtin_lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_from_terms(spark, BUILTIN_TERMS)


def load_lexicon(df: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Terms of the wanted languages out of a source with a word, term or text column."""
    term = F.lower(tx.strip(pick(df, TERM_COLUMNS)))
    return (
        df.filter(F.col("lang").isin(list(langs)))
        .select("lang", term.alias("term"))
        .filter(F.col("term") != "")
        .distinct()
    )


def union_lexicons(*lexicons: DataFrame) -> DataFrame:
    """Distinct union, per language."""
    merged = lexicons[0].select("lang", "term")
    for other in lexicons[1:]:
        merged = merged.unionByName(other.select("lang", "term"))
    return merged.distinct()


def all_language_terms(lexicon: DataFrame) -> DataFrame:
    """The union over the languages, for texts of unknown language: distinct ``term``."""
    return lexicon.select("term").distinct()


def lexicon_growth(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Terms per language before and after adding ``extra``: one pass over both."""
    marked = base.select("lang", "term", F.lit(1).alias("in_base")).unionByName(
        extra.select("lang", "term", F.lit(0).alias("in_base"))
    )
    terms = marked.groupBy("lang", "term").agg(F.max("in_base").alias("in_base"))
    return terms.groupBy("lang").agg(
        F.sum("in_base").cast("bigint").alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        (F.count(F.lit(1)) - F.sum("in_base")).cast("bigint").alias("n_added"),
    )
