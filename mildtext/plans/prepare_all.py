"""Whole preparation: union, clean, split, sample, tokenise, with the language as a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.config import PrepConfig
from mildtext.operators import kmeans
from mildtext.operators.diversity import cluster_samples, require_named, whole_numbers
from mildtext.operators.prepare import PAIR_IDS, preprocess_with_keys, union_sources
from mildtext.operators.quota import random_sample, split_pairs
from mildtext.operators.tokenize import hashed_ids, tokenize_inputs, tokenize_pairs
from mildtext.session import materialize, shared


def clean_and_split(sources: list[DataFrame], cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Cleaned pairs of all sources with their split; the cleaned pairs are written once on the way."""
    wanted = union_sources(*sources).filter(F.col("lang").isin(cfg.langs))
    cleaned, keys = preprocess_with_keys(wanted, cfg.length_ratio)
    return split_pairs(cleaned, cfg.split_ratios, cfg.default_ratios, cfg.seed, PAIR_IDS, keys=keys)


def few_shot_subsets(
    train: DataFrame, cfg: PrepConfig = PrepConfig(), vector: str | None = "embedding",
    ids: list[str] | None = None, n_init: int = 10, steps: int = 20,
) -> DataFrame:
    """For every target language and size, a covering subset, marked by ``n_shots``.

    ``ids`` name a row, also after a union of sources.  With vectors, floats or whole numbers, all
    languages and sizes are clustered together; without, a subset is a seeded sample.
    """
    ids = ids or PAIR_IDS
    rows = train.filter(F.col("lang").isin(*cfg.target_langs))
    if vector is None or vector not in train.columns:
        known = materialize(rows.select(*ids, "lang"))
        require_named(known, [*ids, "lang"])
        chosen = [random_sample(known, n, cfg.seed, ids, "lang").withColumn("n_shots", F.lit(n)) for n in cfg.few_shot_sizes]
        chosen = union_sources(*chosen)
    else:
        fits = kmeans.Fits(cfg.few_shot_sizes, n_init, steps, seed=cfg.seed)
        known = whole_numbers(rows.select(*ids, "lang", vector), vector)
        chosen = cluster_samples(known, fits, ids, vector, "lang").withColumnsRenamed({"grp": "lang", "size": "n_shots"})
    return rows.join(shared(chosen), [*ids, "lang"])


def prepare_pairs(sources: list[DataFrame], cfg: PrepConfig = PrepConfig(),
                  tokenizer=hashed_ids) -> DataFrame:
    """Tokenised pairs with ``lang`` and ``split``."""
    return tokenize_pairs(
        clean_and_split(sources, cfg), max_length=cfg.max_length, prefix=cfg.prefix, tokenizer=tokenizer
    )


def prepare_inputs(inputs: DataFrame, cfg: PrepConfig = PrepConfig(), tokenizer=hashed_ids) -> DataFrame:
    """Tokenised toxic-only inputs."""
    return tokenize_inputs(inputs, "text", cfg.max_length, cfg.prefix, tokenizer)
