"""Few-shot subsets that cover the embedding space: clusters, nearest points, top-up."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mildtext.functions import scores as sc
from mildtext.functions import text as tx
from mildtext.operators import kmeans
from mildtext.operators.quota import random_sample
from mildtext.session import materialize, shared


def assign_given(df: DataFrame, centres: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """Adds ``cluster`` and ``dist`` by given centroids, (number, vector) each; ties go to the lower number.

    The centroids, few by construction, are constants of the expression: a projection.
    """
    given = F.array(*[
        F.struct(F.array(*[F.lit(float(x)) for x in centre]).alias("centre"), F.lit(number).alias("cluster"))
        for number, centre in centres
    ])
    nearest = F.array_min(F.transform(given, lambda c: F.struct(sc.euclidean(F.col(vector), c["centre"]).alias("dist"), c["cluster"].alias("cluster"))))
    return df.withColumn("__near", nearest).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__near.cluster").alias("cluster"), F.col("__near.dist").alias("dist")
    )


def centroid_steps(df: DataFrame, start: list[tuple[int, list[float]]], steps: int, vector: str = "embedding") -> list[tuple[int, list[float]]]:
    """Centroids after a fixed number of K-means steps from given ones; a cluster without rows keeps its centroid.

    A step is one aggregation; only the centroids come to the driver.
    """
    centres = dict(start)
    for _ in range(steps):
        found = group_centroids(assign_given(df, sorted(centres.items()), vector), "cluster", vector)
        centres |= {row["cluster"]: list(row["centre"]) for row in found.collect()}
    return sorted(centres.items())


def group_centroids(df: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per group, combined per task before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(group).agg(vector_to_array(mean).alias("centre"))


def distance_to_centroid(df: DataFrame, centroids: DataFrame, group: str, vector: str) -> DataFrame:
    """Rows with the distance to the centroid of their group."""
    return df.join(shared(centroids), group).withColumn(
        "dist", sc.euclidean(F.col(vector), F.col("centre"))
    )


Ids = str | list[str]


def _listed(ids: Ids) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


def nearest_rows(with_dist: DataFrame, group: str, ids: Ids) -> DataFrame:
    """Per group the ids of the row with the least distance; ties go to the lower ids.

    Each task keeps one row per group, so a group with most rows costs no more.
    """
    ids = _listed(ids)
    return with_dist.groupBy(group).agg(
        F.min(F.struct("dist", *ids)).alias("nearest")
    ).select(group, *[F.col(f"nearest.{c}").alias(c) for c in ids], F.col("nearest.dist").alias("dist"))


def nearest_to_centroid(df: DataFrame, centroids: DataFrame, group: str = "label",
                        vector: str = "embedding", id_col: Ids = "vec_id") -> DataFrame:
    """The row nearest to the given centroid, among the rows of its group."""
    return nearest_rows(distance_to_centroid(df, centroids, group, vector), group, id_col)


def unselected(df: DataFrame, selected: DataFrame, id_col: Ids) -> DataFrame:
    ids = _listed(id_col)
    return df.join(selected.select(*ids), ids, "left_anti")


def top_up(df: DataFrame, selected: DataFrame, missing: int, id_col: Ids, seed: int = 42) -> DataFrame:
    """``missing`` more ids out of the unselected rows, in the seeded order."""
    ids = _listed(id_col)
    rest = unselected(df, selected, ids).select(*ids)
    return (
        rest.withColumn("__digest", tx.seeded_hash(seed, *map(F.col, ids)))
        .orderBy("__digest", *ids)
        .limit(missing)
        .select(*ids)
    )


def cluster_samples(df: DataFrame, fits: kmeans.Fits, ids: list[str], vector: str, group: str | None = None) -> DataFrame:
    """``ids``, ``grp`` (as text; of one name without ``group``) and ``size``: for every group and size, that many
    rows near the centres of as many clusters, or all rows of a group that has no more.

    Every centre in turn takes the nearest row that is not taken yet.  Where rows repeat, there may be
    fewer centres than ``size``; rows in seeded order fill up.  All groups, sizes and restarts are fitted
    together.  ``vector`` holds whole numbers; rows without one only fill up.  ``ids`` that repeat in a
    group are refused.
    """
    points = kmeans.points_of(df, ids, vector, group, fits.seed)
    rows = points.select(*ids, "grp")
    require_named(rows, [*ids, "grp"])
    chosen = materialize(kmeans.chosen_rows(kmeans.near_rows(points, ids, kmeans.fit(points, fits)), ids))
    # the first rows in seeded order, as many as a sample has, hold enough that are not chosen
    order = Window.partitionBy("grp").orderBy(tx.seeded_hash(fits.seed, *map(F.col, ids)), *ids)
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(fits.sizes))
    sized = first.withColumn("size", F.explode(F.array(*map(F.lit, fits.sizes)))).filter("rank <= size")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*ids, "grp", "size"]]
    free = sized.alias("s").join(F.broadcast(chosen).alias("c"), same, "left_anti").withColumn("chosen", F.lit(1))
    both = chosen.withColumns({"chosen": F.lit(0), "rank": F.lit(0)}).unionByName(free)
    place = F.row_number().over(Window.partitionBy("grp", "size").orderBy("chosen", "rank", *ids))
    return both.withColumn("place", place).filter("place <= size").select(*ids, "grp", "size")


def diversity_sample(
    df: DataFrame,
    n: int,
    id_col: Ids = "pair_id",
    vector: str | None = "embedding",
    seed: int = 42,
    n_init: int = 10,
    group: str = "lang",
) -> DataFrame:
    """``n`` rows near the centres of n clusters, or all rows if there are no more than n.

    Without vectors the whole subset is a seeded sample per ``group``.  ``id_col``, one column
    or several, must name a row; ids that repeat are refused, for no number of rows could then be kept.
    """
    ids = _listed(id_col)
    if vector is None or vector not in df.columns:
        require_named(df, ids)
        return random_sample(df, n, seed, ids, group)
    chosen = cluster_samples(whole_numbers(df.select(*ids, vector), vector), kmeans.Fits((n,), n_init, seed=seed), ids, vector)
    return df.join(shared(chosen.select(*ids)), ids, "left_semi")


def require_named(df: DataFrame, ids: list[str]) -> None:
    """Refuse ids that repeat."""
    if df.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"rows with equal {', '.join(ids)}: name them by more columns")


def whole_numbers(df: DataFrame, vector: str) -> DataFrame:
    """``vector`` in whole steps; one of whole numbers stays."""
    if df.schema[vector].dataType.elementType.typeName() in ("integer", "short", "byte"):
        return df
    return df.withColumn(vector, kmeans.fixed(F.col(vector)))
