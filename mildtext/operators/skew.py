"""Joining many rows to a table of values when some keys are very frequent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.session import SHARED_BYTES, measured_bytes

# A key is hot if it holds more than 1/HOT_SHARE of all rows: fewer than HOT_SHARE keys can be.
HOT_SHARE = 10_000


def key_counts(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Rows per key (or the sum of ``weight``); combined before the shuffle."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(*keys).agg(amount.alias("key_rows"))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    values: list[str],
    frequency: DataFrame | Callable[[], DataFrame],
    spread: list[str],
) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique on ``keys``) which no hot key can slow down.

    ``table`` should be written already, since its size is measured.  A small one
    is broadcast.  Otherwise ``frequency`` holds ``keys`` and ``key_rows``, the
    rows of each key; a function is only called then.  Hot keys, fewer than ``HOT_SHARE`` whatever the size of the data, are broadcast
    with their values.  All other keys meet in a shuffle join, in which each has
    a share below 1/HOT_SHARE.  Rows that are answered already go through that
    shuffle under their ``spread`` columns, so they fall evenly over the tasks.
    """
    if measured_bytes(table) <= SHARED_BYTES:
        return rows.join(F.broadcast(table.select(*keys, *values)), keys, "left").select(*rows.columns, *values)
    frequency = frequency() if callable(frequency) else frequency
    total = frequency.agg(F.sum("key_rows").alias("all_rows")).scalar()
    hot_keys = frequency.filter(F.col("key_rows") * F.lit(HOT_SHARE) > total).select(*keys)
    # the table is read past the few hot keys; a hot key it lacks stays hot, without values
    known = table.join(F.broadcast(hot_keys), keys).select(*keys, *values)
    hot = (
        known.unionByName(hot_keys, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.max(v).alias(f"hot_{v}") for v in values])
        .withColumn("is_hot", F.lit(True))
    )
    marked = rows.join(F.broadcast(hot), keys, "left")
    answered = F.col("is_hot").isNotNull()
    # sorted by this number first; the keys themselves decide what matches
    spot = F.when(answered, F.xxhash64(*spread)).otherwise(F.xxhash64(*keys))
    cold = table.select(
        F.xxhash64(*keys).alias("cold_spot"),
        *[F.col(k).alias(f"cold_{k}") for k in keys],
        *[F.col(v).alias(f"cold_{v}") for v in values],
    )
    joined = marked.withColumn("spot", spot).join(
        cold.hint("merge"),
        [F.col("spot") == F.col("cold_spot")]
        + [F.col(k) == F.col(f"cold_{k}") for k in keys]
        + [F.col("is_hot").isNull()],
        "left",
    )
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[
            F.when(answered, F.col(f"hot_{v}")).otherwise(F.col(f"cold_{v}")).alias(v)
            for v in values
        ],
    )
