"""Vectors of texts without a model: signed hashing of character trigrams.

A text is lower-cased, its white space collapsed, and a blank put before and behind it.  Every three
characters in a row give a number out of their code points; it names one of ``width`` places and
a sign.  Counts are whole numbers and equal on every engine.  Vectors of unit length are whole
numbers too, in steps of 1 / :data:`SCALE`, so that sums of them do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.functions.scores import cosine_from_sums
from mildtext.operators.once import once
from mildtext.session import small_batches

WIDTH = 256
SCALE = 4096
# Number of a trigram: code points as digits to this base, modulo a prime.
BASE, PRIME = 1_000_003, 2**31 - 1
# Characters that are hashed together; bounds the memory of a worker.
CHARS_AT_ONCE = 2_000_000


def trigram_counts(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A row of ``width`` signed counts per text, a text being what :func:`shaped` gives."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(chars) < 3:
        return np.zeros((len(texts), width), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[2:] == owner[:-2]
    number = ((chars[:-2] * BASE + chars[1:-1]) % PRIME * BASE + chars[2:]) % PRIME
    number, owner = number[inside], owner[2:][inside]
    sign = 1.0 - 2.0 * (number // width % 2)
    counts = np.bincount(owner * width + number % width, weights=sign, minlength=len(texts) * width)
    return counts.astype(np.int64).reshape(len(texts), width)


def unit_vectors(counts: np.ndarray) -> np.ndarray:
    """Rows of counts at unit length, in whole steps; a row of zeros stays."""
    length = np.sqrt((counts * counts).sum(axis=1, dtype=np.int64).astype(np.float64))
    return np.floor(SCALE * counts / np.where(length > 0, length, 1.0)[:, None]).astype(np.int32)


def shaped(text: Column) -> Column:
    """The form of a text that is hashed; null is empty."""
    return F.concat(F.lit(" "), tx.collapse(F.lower(F.coalesce(text, F.lit("")))), F.lit(" "))


def _parts(*columns: pd.Series) -> Iterator[slice]:
    """Rows whose texts have about :data:`CHARS_AT_ONCE` characters together."""
    ends = np.cumsum(sum(c.str.len().to_numpy() for c in columns)) // CHARS_AT_ONCE
    starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(ends)]
    yield from (slice(a, b) for a, b in zip(starts, starts[1:]) if b > a)


def hashed_vectors(df: DataFrame, text: str, out: str = "vector", width: int = WIDTH) -> DataFrame:
    """Add the vector of a text as ``array<int>``; a projection."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [v for part in _parts(batch) for v in unit_vectors(trigram_counts(batch.iloc[part].tolist(), width))]
            yield pd.Series(found, dtype=object)

    small_batches(df.sparkSession)
    ready = once(df, __shaped=shaped(F.col(text)))
    return ready.withColumn(out, F.pandas_udf(run, "array<int>")("__shaped")).drop("__shaped")


def hashed_similarity(df: DataFrame, left: str, right: str, out: str = "sim", width: int = WIDTH) -> DataFrame:
    """Add the cosine of the trigram counts of two columns, 0 if one has none.

    Both vectors are made and met in the worker: three numbers per row come back.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            found = [np.zeros((0, 3), np.int64)]
            for part in _parts(a, b):
                x, y = (trigram_counts(c.iloc[part].tolist(), width) for c in (a, b))
                found.append(np.stack([(x * y).sum(axis=1), (x * x).sum(axis=1), (y * y).sum(axis=1)], axis=1))
            yield pd.DataFrame(np.concatenate(found), columns=["ab", "aa", "bb"])

    small_batches(df.sparkSession)
    ready = once(df, __left=shaped(F.col(left)), __right=shaped(F.col(right)))
    sums = F.pandas_udf(run, "ab bigint, aa bigint, bb bigint")("__left", "__right")
    met = ready.select(*[F.col(f"`{c}`") for c in df.columns if c != out], sums.alias("__sums"))
    cosine = cosine_from_sums(*(F.col(f"__sums.{p}").cast("double") for p in ("ab", "aa", "bb")))
    return met.withColumn(out, cosine).drop("__sums")
