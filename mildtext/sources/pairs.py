"""Readers of parallel pairs and of toxic-only inputs.

All readers end in one of two shapes::

    pairs   pair_id, lang, source, source_rank, toxic, neutral
    inputs  row_id, lang, text

Text is stripped and blank rows are dropped.  A language filter stays a plain
``isin`` on the language column, so it prunes partitions of a layout written
with ``partitionBy("lang")`` and is pushed into the parquet scan otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.once import once

PAIR_SCHEMA = (
    "pair_id bigint, lang string, source string, source_rank int, toxic string, neutral string"
)
INPUT_SCHEMA = "row_id bigint, lang string, text string"

# Column names of the known sources, in the order they are tried.
PARALLEL_COLUMNS = (("toxic_sentence",), ("neutral_sentence",))
CONVERTED_COLUMNS = (
    ("Original Text", "Original_Text"),
    ("Converted Text", "Converted_Text"),
)
EXTRA_COLUMNS = (
    ("toxic_sentence", "toxic", "original"),
    ("neutral_sentence", "neutral", "detoxified"),
)


def pick(df: DataFrame, names: Iterable[str]) -> Column:
    """First filled column among those of ``names`` that the source has."""
    present = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return tx.first_filled(*present)


def normalize_pairs(
    df: DataFrame,
    source: str,
    source_rank: int = 0,
    columns: tuple[Sequence[str], Sequence[str]] = EXTRA_COLUMNS,
    lang: Column | str = "lang",
    pair_id: str = "pair_id",
) -> DataFrame:
    """Bring any pair source into the pair shape; blank sides are dropped."""
    lang_col = F.col(lang) if isinstance(lang, str) else lang
    return normalize_pairs_keep_blank(df, source, source_rank, columns, lang_col, pair_id).filter(
        (F.col("toxic") != "") & (F.col("neutral") != "")
    )


def normalize_pairs_keep_blank(
    df: DataFrame,
    source: str,
    source_rank: int,
    columns: tuple[Sequence[str], Sequence[str]],
    lang: Column,
    pair_id: str = "pair_id",
) -> DataFrame:
    """As :func:`normalize_pairs`, keeping blank rows for the cleaning funnel."""
    sides = df.select(
        F.col(pair_id).cast("bigint").alias("pair_id"),
        lang.alias("lang"),
        F.lit(source).alias("source"),
        F.lit(source_rank).alias("source_rank"),
        pick(df, columns[0]).alias("toxic"),
        pick(df, columns[1]).alias("neutral"),
    )
    return once(sides, toxic=tx.strip(F.col("toxic")), neutral=tx.strip(F.col("neutral")))


def load_pairs(
    df: DataFrame,
    langs: Sequence[str],
    source: str = "parallel",
    source_rank: int = 0,
    columns: tuple[Sequence[str], Sequence[str]] = PARALLEL_COLUMNS,
) -> DataFrame:
    """Parallel pairs of the wanted languages; a language without rows yields none."""
    wanted = df.filter(F.col("lang").isin(list(langs)))
    return normalize_pairs(wanted, source, source_rank, columns)


def load_inputs(
    df: DataFrame, langs: Sequence[str], text: str = "text", row_id: str = "row_id"
) -> DataFrame:
    """Toxic-only inputs of the wanted languages."""
    wanted = df.filter(F.col("lang").isin(list(langs))).select(
        F.col(row_id).cast("bigint").alias("row_id"), "lang", F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return once(wanted, text=tx.strip(F.col("text"))).filter(F.col("text") != "")


def load_labelled_pairs(
    df: DataFrame,
    langs: Sequence[str],
    source: str,
    source_rank: int = 0,
    columns: tuple[Sequence[str], Sequence[str]] = PARALLEL_COLUMNS,
) -> DataFrame:
    """Pairs whose language label is free text: cut to two lower-case letters, then filtered."""
    named = df.withColumn("lang", tx.normalize_lang(F.coalesce(F.col("lang"), F.lit(""))))
    return load_pairs(named, langs, source, source_rank, columns)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
               **options: str) -> DataFrame:
    """Parquet, JSON lines or CSV; CSV has a header and may hold line breaks in quotes."""
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.load(path)


def read_or_empty(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: str = "pair_id bigint, lang string, toxic string, neutral string",
                  **options: str) -> DataFrame:
    """As :func:`read_files`; a missing path gives no rows, so optional sources may be absent."""
    try:
        return read_files(spark, path, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_pairs(df: DataFrame, path: str) -> None:
    """Parquet with one folder per language, which :func:`load_pairs` prunes."""
    df.write.mode("overwrite").partitionBy("lang").parquet(path)
