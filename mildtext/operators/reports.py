"""Tables and series out of evaluation records (one row per experiment and language)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _column(df: DataFrame, *names: str):
    """First present and non-null of several columns; null if the records have none of them."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def results_table(records: DataFrame) -> DataFrame:
    """Short listing; missing fields are null, so that numbers stay numbers."""
    return records.select(
        F.coalesce(_column(records, "experiment", "method"), F.lit("?")).alias("experiment"),
        F.coalesce(_column(records, "language", "lang"), F.lit("?")).alias("lang"),
        _column(records, "toxicity_pct_below_threshold").cast("double").alias("sta_pct"),
        _column(records, "similarity_mean").cast("double").alias("sim"),
        _column(records, "fluency_ppl_mean").cast("double").alias("ppl"),
        _column(records, "bleu").cast("double").alias("bleu"),
        _column(records, "chrf").cast("double").alias("chrf"),
        _column(records, "j2_score").cast("double").alias("j2"),
        _column(records, "j3_score").cast("double").alias("j3"),
    )


def results_listing(records: DataFrame) -> DataFrame:
    """File, language and main scores of loaded records."""
    return records.select("_file", "lang", "toxicity_mean", "similarity_mean", "bleu")


def enrich_runs(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records with the fields of their run; records without a run stay."""
    return records.join(runs, "experiment", "left")


def pending_evaluations(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned experiments without a finished record."""
    keys = [c for c in ("experiment", "lang") if c in planned.columns]
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def sample_efficiency(zero_shot: DataFrame, few_shot: DataFrame) -> DataFrame:
    """Curve per language and method: scores at zero shots and at every subset size."""
    fields = ["lang", "method", "n_shots", "toxicity_mean", "similarity_mean"]
    curve = zero_shot.withColumn("n_shots", F.lit(0)).select(*fields)
    return curve.unionByName(few_shot.select(*fields)).orderBy("lang", "method", "n_shots")


def method_comparison(few_shot: DataFrame, methods: list[str], n_shots: int = 200) -> DataFrame:
    """Methods side by side per language at one subset size.

    The methods are given, so the pivot needs no pass to find them.
    """
    return (
        few_shot.filter(F.col("n_shots") == n_shots)
        .groupBy("lang")
        .pivot("method", methods)
        .agg(
            F.max("toxicity_mean").alias("toxicity"),
            F.max("similarity_mean").alias("similarity"),
        )
        .orderBy("lang")
    )


def ablation_series(records: DataFrame, factor: str, values: list, fixed: dict[str, object]) -> DataFrame:
    """Scores along one factor, the others held at ``fixed``; a value without a record gives nulls.

    The shared base point belongs to every series it lies on, whatever series it was run for.
    """
    line = records
    for name, value in fixed.items():
        line = line.filter(F.col(name) == F.lit(value))
    langs = records.select("lang").distinct()
    grid = langs.withColumn(factor, F.explode(F.array(*[F.lit(v) for v in values])))
    return (
        grid.join(line.select("lang", factor, "toxicity_mean", "similarity_mean"), ["lang", factor], "left")
        .select(
            F.lit(factor).alias("factor"),
            "lang",
            F.col(factor).cast("string").alias("value"),
            "toxicity_mean",
            "similarity_mean",
        )
        .orderBy("lang", "value")
    )


def experiment_summary(baselines: DataFrame, zero_shot: DataFrame, few_shot: DataFrame) -> DataFrame:
    """All experiments in one table, ordered by language, method and shots.

    Shots of a baseline are null (ordered first); BLEU exists for baselines only.
    """
    common = [
        "experiment",
        "lang",
        F.col("toxicity_mean").alias("toxicity"),
        F.col("toxicity_pct_below_threshold").alias("tox_below_pct"),
        F.col("similarity_mean").alias("similarity"),
    ]
    parts = baselines.select(*common, F.lit("baseline").alias("method"), "bleu")
    parts = parts.unionByName(
        zero_shot.select(*common, "method", F.lit(0).alias("n_shots")), allowMissingColumns=True
    )
    parts = parts.unionByName(few_shot.select(*common, "method", "n_shots"), allowMissingColumns=True)
    return parts.select(
        "experiment", "lang", "method", "n_shots", "toxicity", "tox_below_pct", "similarity", "bleu"
    ).orderBy("lang", "method", F.col("n_shots").asc_nulls_first(), "experiment")
