"""Scores per rewrite, and one record per experiment and language.

Predictions have the shape ``row_id, experiment, lang, toxic, prediction`` and,
with references, ``neutral``.  A row is identified by (experiment, row_id).
All experiments are evaluated together: one aggregation grouped by experiment
and language replaces a run of the evaluator per experiment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.config import EvalConfig
from mildtext.functions import scores as sc
from mildtext.operators import grams
from mildtext.operators.bootstrap import bootstrap_ci
from mildtext.operators.rewrite import Terms, flags_by_scope
from mildtext.operators.score import BigramModel, bigram_perplexity, lexicon_toxicity_counted
from mildtext.session import materialize

KEYS = ["experiment", "row_id"]
BY = ["experiment", "lang"]


def join_predictions(inputs: DataFrame, predictions: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Inputs with their predictions, by id."""
    return inputs.join(predictions, id_col)


def add_row_scores(scored: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """From ``tox``, ``sim`` and ``ppl``: success, similarity test, fluency and row products."""
    return (
        scored.withColumn("sta", sc.success(F.col("tox"), cfg.toxicity_threshold))
        .withColumn("sim_ok", sc.similar(F.col("sim"), cfg.similarity_threshold).cast("double"))
        .withColumn("fl", sc.normalized_fluency(F.col("ppl"), cfg.base_ppl))
        .withColumn("j2", F.col("sta") * F.col("sim"))
        .withColumn("j3", F.col("sta") * F.col("sim") * F.col("fl"))
    )


def _rounded_mean(c: str, places: int, factor: float = 1.0) -> Column:
    return F.round(F.avg(c) * factor, places)


def j_scores(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """J2, and J3 where every row has a fluency."""
    return rows.groupBy(*by).agg(*_j_columns())


def _j_columns() -> list[Column]:
    complete = F.count("fl") == F.count(F.lit(1))
    return [
        _rounded_mean("j2", 4).alias("j2_score"),
        F.when(complete, _rounded_mean("j3", 4)).alias("j3_score"),
    ]


def fluency_summary(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mean perplexity and mean fluency of the rows that have one."""
    return rows.groupBy(*by).agg(*_fluency_columns())


def _fluency_columns() -> list[Column]:
    return [
        _rounded_mean("ppl", 2).alias("fluency_ppl_mean"),
        _rounded_mean("fl", 4).alias("fluency_norm_mean"),
    ]


def summarize(rows: DataFrame, by: list[str] = BY, more: list[Column] | None = None) -> DataFrame:
    """The record of every experiment and language out of its scored rows, in one aggregation."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        _rounded_mean("tox", 4).alias("toxicity_mean"),
        _rounded_mean("sta", 4).alias("sta"),
        _rounded_mean("sta", 2, 100.0).alias("toxicity_pct_below_threshold"),
        _rounded_mean("sim", 4).alias("similarity_mean"),
        _rounded_mean("sim_ok", 2, 100.0).alias("similarity_pct_above_threshold"),
        *_fluency_columns(),
        *_j_columns(),
        *(more or []),
    )


def score_rows(
    predictions: DataFrame,
    terms: Terms,
    model: BigramModel | None,
    cfg: EvalConfig = EvalConfig(),
    match: str = "prefix",
    with_references: bool = False,
) -> DataFrame:
    """One row per prediction with tox, sim, ppl and the derived scores, by the default scorers.

    Toxicity and similarity, and with references the n-gram overlap, are computed
    in place, in one pass through Python; their numbers go with the words of the prediction to
    the perplexity, so the texts are read, and the predictions made, once.  ``model=None``
    leaves the fluency out.
    """
    kinds = {"term": ("toxic", "prediction")}
    if with_references:
        kinds |= {"word": ("prediction", "neutral"), "char": ("prediction", "neutral")}
    flags = flags_by_scope(predictions, [(terms, match)])
    rows = lexicon_toxicity_counted(grams.add_overlaps(predictions, (flags, "lang"), **kinds))
    rows = rows.withColumn("sim", grams.term_cosine())
    numbers = ["lang", "tox", "sim", *[k for k in kinds if k != "term"]]
    if model is None:
        rows = rows.select(*KEYS, *numbers).withColumn("ppl", F.lit(None).cast("double"))
    else:
        rows = bigram_perplexity(rows.select(*KEYS, *numbers, "prediction"), model, KEYS, text="prediction", carry=numbers)
    return add_row_scores(rows, cfg)


def _with_ci(record: DataFrame, rows: DataFrame, cfg: EvalConfig) -> DataFrame:
    ci = bootstrap_ci(
        rows.select(*KEYS, "lang", "tox", "sim", "j2"), KEYS, BY, ["tox", "sim", "j2"],
        cfg.bootstrap_n, cfg.bootstrap_ci, cfg.seed,
    )
    named = ci.withColumnsRenamed({"tox_ci": "toxicity_ci", "sim_ci": "similarity_ci"})
    return record.join(named, BY, "left")


def evaluate_noref(
    predictions: DataFrame,
    terms: Terms,
    model: BigramModel | None,
    cfg: EvalConfig = EvalConfig(),
    match: str = "prefix",
    compute_bootstrap: bool = True,
) -> DataFrame:
    """Evaluation without references: BLEU and chrF are null."""
    rows = score_rows(predictions, terms, model, cfg, match)
    missing = {"bleu": F.lit(None).cast("double"), "chrf": F.lit(None).cast("double")}
    if not compute_bootstrap:
        return summarize(rows).withColumns(missing)
    # a few numbers per prediction, read by the summary and by the bootstrap
    rows = materialize(rows)
    return _with_ci(summarize(rows).withColumns(missing), rows, cfg)


def evaluate_ref(
    predictions: DataFrame,
    terms: Terms,
    model: BigramModel | None,
    cfg: EvalConfig = EvalConfig(),
    match: str = "prefix",
    compute_bootstrap: bool = True,
) -> DataFrame:
    """Evaluation against references: everything of :func:`evaluate_noref` plus BLEU and chrF."""
    rows = score_rows(predictions, terms, model, cfg, match, with_references=True)
    if compute_bootstrap:
        rows = materialize(rows)
    sums = [*grams.corpus_sums("word"), *grams.corpus_sums("char")]
    record = summarize(rows, BY, sums).withColumns(
        {"bleu": F.round(grams.bleu(), 2), "chrf": F.round(grams.chrf(), 2)}
    )
    record = record.drop(*[c for c in record.columns if c.startswith(("word_", "char_"))])
    return _with_ci(record, rows, cfg) if compute_bootstrap else record


def flatten_ci(record: DataFrame) -> DataFrame:
    """Interval structs as plain columns, for tables and CSV."""
    for name in [c for c in record.columns if c.endswith("_ci")]:
        for part in ("mean", "lower", "upper"):
            record = record.withColumn(f"{name}_{part}", F.col(f"{name}.{part}"))
        record = record.drop(name)
    return record
