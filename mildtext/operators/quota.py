"""Exact counts out of a seeded order, without sorting the data.

Rows are ordered by a digest of (seed, id).  To cut a group after its k-th row
only the k-th digest is needed:

1. count rows per (group, first digits of the digest);
2. the running total over those few counts names the bucket that holds row k;
3. rank the rows of that bucket alone and take its row as the threshold;
4. compare every row with the threshold, in place.

Steps 1 to 3 read only the group and id columns, and step 4 adds no shuffle, so
the texts never move, and a language that holds most rows is no hot task.
Steps 1 to 3 run when the operator is called, since their result, two rows per
group, is checked to be small before it is shared with every task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.session import materialize, shared

# 16^4 buckets: the ranked bucket holds about 1/65536 of its group.
BUCKET_DIGITS = 4


def _ordered(df: DataFrame, group: str, ids: list[str], seed: int) -> DataFrame:
    return df.select(
        F.col(group).alias("grp"),
        F.struct(tx.seeded_hash(seed, *map(F.col, ids)).alias("digest"), *ids).alias("ord"),
    ).withColumn("bucket", F.substring(F.col("ord.digest"), 1, BUCKET_DIGITS))


def thresholds(
    df: DataFrame, group: str, ids: list[str], seed: int, cuts: dict[str, Column]
) -> DataFrame:
    """Per group and named cut, the order value of the last row inside the cut.

    ``cuts`` are expressions over ``n``, the rows of the group.  A cut of zero
    rows has no threshold (null).  One row per group.
    """
    ordered = _ordered(df, group, ids, seed)
    counts = ordered.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n_bucket"))
    whole = Window.partitionBy("grp")
    # at most 16^BUCKET_DIGITS rows per group
    running = (
        counts.withColumn("n", F.sum("n_bucket").over(whole))
        .withColumn("upto", F.sum("n_bucket").over(whole.orderBy("bucket")))
        .withColumn(
            "cut",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("name"), expr.cast("bigint").alias("rank"))
                        for name, expr in cuts.items()
                    ]
                )
            ),
        )
    )
    offset = F.col("cut.rank") - (F.col("upto") - F.col("n_bucket"))
    # one row per group and cut
    holding = running.filter((offset >= 1) & (offset <= F.col("n_bucket"))).select(
        "grp", "bucket", F.col("cut.name").alias("cut"), offset.alias("nth")
    )
    holding = shared(holding)
    inside = Window.partitionBy("grp", "cut").orderBy("ord")
    found = (
        ordered.join(
            holding.withColumnRenamed("grp", "its_grp"),
            F.col("grp").eqNullSafe(F.col("its_grp")) & (ordered["bucket"] == holding["bucket"]),
        )
        .withColumn("pos", F.row_number().over(inside))
        .filter(F.col("pos") == F.col("nth"))
    )
    return found.groupBy("grp").agg(
        *[F.max(F.when(F.col("cut") == name, F.col("ord"))).alias(name) for name in cuts]
    )


def _with_thresholds(
    df: DataFrame, group: str, ids: list[str], seed: int, cuts: dict[str, Column], keys: DataFrame | None = None
) -> DataFrame:
    # the keys are read three times, whatever it takes to make the rows
    keys = materialize(df.select(*dict.fromkeys([group, *ids]))) if keys is None else keys
    limits = shared(thresholds(keys, group, ids, seed, cuts))
    here = F.struct(tx.seeded_hash(seed, *map(F.col, ids)).alias("digest"), *ids)
    limits = limits.withColumnRenamed("grp", "__grp")
    return (
        df.withColumn("__ord", here)
        .join(limits, F.col(group).eqNullSafe(F.col("__grp")), "left")
        .drop("__grp")
    )


def split_pairs(
    pairs: DataFrame,
    ratios: Mapping[str, tuple[float, float]],
    default: tuple[float, float] = (0.25, 0.0),
    seed: int = 42,
    ids: list[str] | None = None,
    group: str = "lang",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split``: train, val or test, with exact counts per language.

    ``ratios`` maps a language to its validation and test share.  Validation
    gets ``max(1, floor(n * share))`` rows, test ``floor(n * share)`` and train
    the rest; the seeded order is cut into train, val, test in that sequence.
    ``keys``, if known and cheap to read, are the groups and ids of ``pairs``.
    """
    ids = ids or ["pair_id"]

    def share(position: int) -> Column:
        chosen = F.lit(float(default[position]))
        for lang, pair in ratios.items():
            chosen = F.when(F.col("grp") == lang, F.lit(float(pair[position]))).otherwise(chosen)
        return chosen

    n = F.col("n")
    n_val = F.greatest(F.lit(1), F.floor(n * share(0)))
    n_test = F.floor(n * share(1))
    cuts = {"last_train": n - n_val - n_test, "last_val": n - n_test}
    marked = _with_thresholds(pairs, group, ids, seed, cuts, keys)
    split = (
        F.when(F.col("__ord") <= F.col("last_train"), "train")
        .when(F.col("__ord") <= F.col("last_val"), "val")
        .otherwise("test")
    )
    return marked.withColumn("split", split).drop("__ord", "last_train", "last_val")


def random_sample(
    df: DataFrame, n: int, seed: int = 42, ids: list[str] | None = None, group: str = "lang"
) -> DataFrame:
    """``n`` rows per group without replacement, or all rows of a smaller group."""
    ids = ids or ["pair_id"]
    marked = _with_thresholds(
        df, group, ids, seed, {"last_in": F.least(F.col("n"), F.lit(n).cast("bigint"))}
    )
    return marked.filter(F.col("__ord") <= F.col("last_in")).drop("__ord", "last_in")
