"""Scorers: toxicity, similarity, fluency, and the harness for outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.functions import scores as sc
from mildtext.functions import text as tx
from mildtext.operators import bigrams, grams
from mildtext.operators.rewrite import Terms, count_flagged, count_flagged_inline
from mildtext.session import small_batches

# --- toxicity ---------------------------------------------------------------


def lexicon_toxicity(
    df: DataFrame, terms: Terms, match: str = "exact", text: str = "text", lang: str = "lang",
    out: str = "tox",
) -> DataFrame:
    """Toxicity out of term hits: none gives 0, one 0.5, more tend to 1; a projection.

    Also adds ``n_tokens``, ``n_flagged`` and ``tox_ratio``, the share of flagged tokens.
    """
    return _hits_to_toxicity(count_flagged_inline(df, terms, match, text, lang), out)


def lexicon_toxicity_counted(counted: DataFrame, out: str = "tox") -> DataFrame:
    """As :func:`lexicon_toxicity` where ``n_tokens`` and ``n_flagged`` are there already."""
    return _hits_to_toxicity(counted, out)


def lexicon_toxicity_joined(
    df: DataFrame, lexicon: DataFrame, id_col: str, match: str = "exact", text: str = "text",
    lang: str = "lang", out: str = "tox",
) -> DataFrame:
    """As :func:`lexicon_toxicity` for a lexicon of any size."""
    return _hits_to_toxicity(count_flagged(df, lexicon, id_col, match, text, lang), out)


def _hits_to_toxicity(counted: DataFrame, out: str) -> DataFrame:
    hits = F.col("n_flagged")
    ratio = F.coalesce(F.try_divide(hits, F.col("n_tokens")), F.lit(0.0))
    return counted.withColumn("tox_ratio", ratio).withColumn(out, hits / (hits + 1))


def fit_toxicity_model(labelled: DataFrame, text: str = "text", label: str = "toxic",
                       features: int = 1 << 16) -> PipelineModel:
    """Word-count logistic regression; the fit is a distributed tree aggregation per step."""
    pipeline = Pipeline(
        stages=[
            HashingTF(inputCol="model_words", outputCol="model_tf", numFeatures=features, binary=True),
            IDF(inputCol="model_tf", outputCol="model_features", minDocFreq=1),
            LogisticRegression(featuresCol="model_features", labelCol="model_label", regParam=0.01,
                               maxIter=30, probabilityCol="model_p", rawPredictionCol="model_raw",
                               predictionCol="model_class"),
        ]
    )
    rows = labelled.select(
        tx.words(F.lower(F.col(text))).alias("model_words"),
        F.col(label).cast("double").alias("model_label"),
    )
    return pipeline.fit(rows)


def score_toxicity_model(df: DataFrame, model: PipelineModel, text: str = "text",
                         out: str = "tox") -> DataFrame:
    keep = df.columns
    ready = df.withColumn("model_words", tx.words(F.lower(F.col(text))))
    return model.transform(ready).select(*keep, vector_to_array("model_p")[1].alias(out))


# --- outside models ---------------------------------------------------------


def apply_model(
    df: DataFrame,
    load: Callable[[], Callable[..., list]],
    inputs: list[str],
    out: str,
    out_type: str,
    batch_size: int = 32,
) -> DataFrame:
    """Add a column computed by a model over batches of rows.

    ``load`` runs once per Python worker and returns a function from lists (one
    per input column) to a list of results, called with ``batch_size`` rows at
    most.  Only the input columns travel to Python.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            results: list = []
            for at in range(0, len(columns[0]), batch_size):
                part = [c.iloc[at : at + batch_size].tolist() for c in columns]
                results.extend(model(*part))
            yield pd.Series(results, dtype=object)

    small_batches(df.sparkSession)
    udf = F.pandas_udf(_single(run) if len(inputs) == 1 else run, out_type)
    return df.withColumn(out, udf(*inputs))


def _single(run):
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run((batch,) for batch in batches)

    return one


def model_toxicity(df: DataFrame, load, text: str = "text", out: str = "tox",
                   batch_size: int = 32) -> DataFrame:
    """Toxicity by a classifier returning ``{label: score}`` per text."""
    labelled = apply_model(df, load, [text], "label_map", "map<string,double>", batch_size)
    return labelled.withColumn(out, sc.label_map_toxicity(F.col("label_map"))).drop("label_map")


def model_similarity(df: DataFrame, load, left: str, right: str, out: str = "sim",
                     batch_size: int = 64) -> DataFrame:
    """Cosine of the vectors an embedding model gives both texts."""
    both = apply_model(df, load, [left], "left_vector", "array<float>", batch_size)
    both = apply_model(both, load, [right], "right_vector", "array<float>", batch_size)
    return both.withColumn(out, sc.cosine(F.col("left_vector"), F.col("right_vector"))).drop(
        "left_vector", "right_vector"
    )


def model_perplexity(df: DataFrame, load, text: str = "text", out: str = "ppl",
                     batch_size: int = 1) -> DataFrame:
    """Perplexity by a language model; null where the model gives None."""
    return apply_model(df, load, [text], out, "double", batch_size)


def rewrite_batch(df: DataFrame, load, text: str = "text", out: str = "prediction",
                  prefix: str = "detoxify: ", batch_size: int = 16) -> DataFrame:
    """Rewrite by a sequence model, which receives ``prefix + text``."""
    asked = df.withColumn("model_input", F.concat(F.lit(prefix), F.col(text)))
    return apply_model(asked, load, ["model_input"], out, "string", batch_size).drop("model_input")


# --- similarity -------------------------------------------------------------


def count_similarity(df: DataFrame, left: str, right: str, out: str = "sim") -> DataFrame:
    """Add the cosine of the lower-case word counts of two columns."""
    return grams.add_overlap(df, "term", left, right).withColumn(out, grams.term_cosine()).drop("term")


# --- fluency ----------------------------------------------------------------

ADD_K = 0.1


class BigramModel:
    """Add-k bigram language model per language: the corpus that is counted, and how.

    The pairs that texts ask for are counted when they ask (``operators/bigrams.py``).
    """

    def __init__(self, corpus: DataFrame, text: str = "text", lang: str = "lang", k: float = ADD_K):
        self.corpus, self.text, self.lang, self.k = corpus, text, lang, k


def bigram_perplexity(
    df: DataFrame, model: BigramModel, keys: list[str], text: str = "text", lang: str = "lang",
    out: str = "ppl", same_corpus: bool = False, carry: list[str] | None = None,
) -> DataFrame:
    """Keys and exp(-mean ln p) of every text; null for a text without words, and for a
    language that the model has never seen.

    ``same_corpus`` says that ``df`` is what the model is counted on: then it is read once.
    ``keys`` name a text.  With ``carry``, the rows of ``df`` come back with their keys, these columns and
    the perplexity, as a left join by the keys would give them, with no second pass over ``df``.
    """
    found = bigrams.log_sums(df, model.corpus, [*keys, *(carry or [])], text, lang, model.text, model.lang, model.k, same_corpus)
    if carry is None:
        return found.groupBy(*keys).agg(_perplexity(lambda c: c).alias(out))
    missing = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    # rows without a key meet no other; their numbers spread them over the tasks
    spread = F.when(missing, F.xxhash64("n", "ln_sum"))
    own = Window.partitionBy(*keys, "__spread")
    whole = found.withColumn("__spread", spread).withColumn(out, _perplexity(lambda c: c.over(own)))
    return whole.select(*keys, *carry, F.when(~missing, F.col(out)).alias(out))


def _perplexity(over: Callable[[Column], Column]) -> Column:
    known = over(F.count("ln_sum")) == over(F.count(F.lit(1)))
    return F.when(known, F.exp(-F.try_divide(over(F.sum("ln_sum")), over(F.sum("n")))))


def terms_of(lexicon_rows: Mapping[str, list[str]], *more: Mapping[str, list[str]]) -> Terms:
    """Union of term lists per language."""
    merged: dict[str, set[str]] = {}
    for group in (lexicon_rows, *more):
        for lang, terms in group.items():
            merged.setdefault(lang, set()).update(terms)
    return {lang: sorted(terms) for lang, terms in merged.items()}
