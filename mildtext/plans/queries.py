"""The registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.config import EvalConfig, PrepConfig
from mildtext.functions import scores as sc
from mildtext.functions import text as tx
from mildtext.functions.terms import BUILTIN_TERMS
from mildtext.operators import (
    bootstrap,
    diversity,
    evaluate,
    grams,
    kmeans,
    prepare,
    quota,
    reports,
    rewrite,
    score,
    vectors,
)
from mildtext.operators import tokenize as tk
from mildtext.plans import views as vw
from mildtext.plans.prepare_all import clean_and_split, few_shot_subsets
from mildtext.plans.prepare_all import prepare_pairs as prepare_all_pairs
from mildtext.session import materialize, scratch
from mildtext.sources import cache, files
from mildtext.sources import lexicon as lx
from mildtext.sources import pairs as ps
from mildtext.sources import results as rs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PREP = PrepConfig(target_langs=("de", "es", "fr"))
EVAL = EvalConfig()
SAMPLE = 50
BOOTSTRAP_N = 1000
STEP_CLUSTERS = 8
STEPS = 2
CLUSTERS = kmeans.Fits((10,), restarts=3, steps=8)
FEW_SHOT_FITS = 10
FEW_SHOT_STEPS = 8


def query(function):
    QUERIES[function.__name__] = function
    return function


def _round(c: str | Column, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def _joined(c: str) -> Column:
    return F.array_join(F.col(c), ",")


def _judge() -> dict[str, list[str]]:
    return vw.per_language(vw.JUDGE_TERMS)


def _model(spark: SparkSession, sf_dir: str) -> score.BigramModel:
    return score.BigramModel(vw.table(spark, sf_dir, "documents"))


# --- sources ----------------------------------------------------------------


@query
def load_pairs(spark, sf_dir):
    return ps.load_pairs(vw.doc_pairs(spark, sf_dir), ["en", "es"])


@query
def load_inputs(spark, sf_dir):
    return ps.load_inputs(vw.table(spark, sf_dir, "documents"), ["en", "es"], row_id="doc_id")


@query
def normalize_pairs(spark, sf_dir):
    converted, _, extra = vw.pair_sources(spark, sf_dir)
    return converted.unionByName(extra)


@query
def normalize_lang(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents")
    region = F.concat(F.lit(" \t"), F.upper("lang"), F.lit("_"), F.col("source"))
    labelled = documents.select(
        F.col("doc_id").alias("pair_id"), region.alias("lang"),
        F.col("text").alias("toxic_sentence"), F.col("source").alias("neutral_sentence"),
    )
    return ps.load_labelled_pairs(labelled, ["de", "es"], "labelled")


@query
def union_sources(spark, sf_dir):
    merged = prepare.union_sources(*vw.pair_sources(spark, sf_dir))
    return merged.select(
        "source", "source_rank", "pair_id", "lang",
        tx.pair_hash(F.col("toxic"), F.col("neutral")).alias("pair_hash"),
    )


@query
def load_lexicon(spark, sf_dir):
    loaded = lx.load_lexicon(vw.benchmark_terms(spark, sf_dir), ["en", "es"])
    return lx.union_lexicons(lx.builtin_lexicon(spark), loaded)


@query
def lexicon_growth(spark, sf_dir):
    loaded = lx.load_lexicon(vw.benchmark_terms(spark, sf_dir), ["en", "es"])
    return lx.lexicon_growth(lx.builtin_lexicon(spark), loaded)


# --- scalars ----------------------------------------------------------------


@query
def text_normalize(spark, sf_dir):
    text = F.col("text")
    return vw.table(spark, sf_dir, "documents").select(
        "doc_id", tx.strip(text).alias("stripped"), tx.collapse(text).alias("collapsed"),
        tx.word_count(text).cast("bigint").alias("n_words"),
    )


def _vocabulary(spark, sf_dir):
    tokens = rewrite.distinct_tokens(vw.table(spark, sf_dir, "documents"), "doc_id")
    return rewrite.vocabulary(tokens).withColumnRenamed("key_rows", "n_texts")


@query
def token_clean(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query
def label_to_toxicity(spark, sf_dir):
    labels = vw.table(spark, sf_dir, "labels")
    s, q = F.col("toxic") * 0.8 + 0.1, F.col("quality") * 0.5 + 0.2
    kind = F.col("doc_id") % 6
    label_map = (
        F.when(kind == 0, F.create_map(F.lit("TOXIC"), s, F.lit("neutral"), q))
        .when(kind == 1, F.create_map(F.lit("Neutral"), q))
        .when(kind == 2, F.create_map(F.lit("non_toxic"), q, F.lit("label_0"), s))
        .when(kind == 3, F.create_map(F.lit("LABEL_0"), q, F.lit("LABEL_1"), s))
        .when(kind == 4, F.create_map(F.lit("LABEL_0"), s))
        .otherwise(F.create_map(F.lit("other"), s))
    )
    return labels.select("doc_id", _round(sc.label_map_toxicity(label_map)).alias("tox"))


# --- preparation ------------------------------------------------------------


@query
def length_ratio_filter(spark, sf_dir):
    kept = prepare.length_ratio_filter(prepare.union_sources(*vw.pair_sources(spark, sf_dir)))
    return kept.select(
        "source", "pair_id", F.col("n_toxic").cast("bigint").alias("n_toxic"),
        F.col("n_neutral").cast("bigint").alias("n_neutral"),
        _round(prepare.length_ratio()).alias("ratio"),
    )


@query
def dedup_pairs(spark, sf_dir):
    unique = prepare.dedup_pairs(prepare.union_sources(*vw.pair_sources(spark, sf_dir)))
    return unique.select("source", "source_rank", "pair_id", "lang", "pair_hash")


@query
def preprocess_pairs(spark, sf_dir):
    cleaned = prepare.preprocess_pairs(prepare.union_sources(*vw.raw_pair_sources(spark, sf_dir)))
    return cleaned.select("source", "pair_id", "lang", "toxic", "neutral")


@query
def preprocess_funnel(spark, sf_dir):
    return prepare.preprocess_funnel(prepare.union_sources(*vw.raw_pair_sources(spark, sf_dir)))


def _split_documents(spark, sf_dir):
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    return quota.split_pairs(pairs, PREP.split_ratios, PREP.default_ratios)


@query
def split_pairs(spark, sf_dir):
    return _split_documents(spark, sf_dir).select("pair_id", "lang", "split")


@query
def split_preview(spark, sf_dir):
    return prepare.split_preview(_split_documents(spark, sf_dir))


@query
def data_summary(spark, sf_dir):
    pairs = prepare.data_summary(_split_documents(spark, sf_dir))
    inputs = vw.toxic_inputs(spark, sf_dir).withColumn("split", F.lit("test_noref"))
    return pairs.unionByName(prepare.data_summary(inputs, "texts")).orderBy("lang", "split")


@query
def random_sample(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents")
    return quota.random_sample(documents, SAMPLE, ids=["doc_id"]).select("doc_id", "lang")


@query
def prepare_pairs(spark, sf_dir):
    ready = prepare_all_pairs(vw.pair_sources(spark, sf_dir), PREP)
    return ready.select(
        "source", "pair_id", "lang", "split", _joined("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("n_ids"),
        _joined("labels").alias("labels"),
    )


@query
def prepare_few_shot(spark, sf_dir):
    """Subsets of the training pairs for every target language and size; without vectors, a seeded sample."""
    ready = clean_and_split(vw.pair_sources(spark, sf_dir), PREP)
    train = ready.filter(F.col("split") == "train").select("source", "source_rank", "pair_id", "lang")
    return few_shot_subsets(train, PREP, vector=None)


@query
def prepare_few_shot_vectors(spark, sf_dir):
    """Covering subsets of the training pairs, of the default sizes, by the vectors of their toxic side."""
    ready = clean_and_split(vw.pair_sources(spark, sf_dir), PREP)
    train = ready.filter(F.col("split") == "train").select("source", "source_rank", "pair_id", "lang", "toxic")
    known = vectors.hashed_vectors(train, "toxic")
    chosen = few_shot_subsets(known, PREP, "vector", n_init=FEW_SHOT_FITS, steps=FEW_SHOT_STEPS)
    return chosen.select("source", "source_rank", "pair_id", "lang", F.col("n_shots").cast("bigint").alias("n_shots"))


@query
def tokenized_roundtrip(spark, sf_dir):
    """Tokenised pairs written as a dataset by language and split, and read back."""
    folder = f"{scratch(spark)}/tokenized-{uuid.uuid4().hex}"
    tk.save_tokenized(prepare_all_pairs(vw.pair_sources(spark, sf_dir), PREP), folder)
    back = tk.load_tokenized(spark, folder)
    return back.select(
        "source", "pair_id", "lang", "split", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"),
    )


@query
def detox_test_split(spark, sf_dir):
    """Sources to clean pairs to the held-back split, rewritten and evaluated against its references."""
    ready = clean_and_split(vw.pair_sources(spark, sf_dir), PREP)
    held = ready.filter(F.col("split") != "train").select(
        F.concat_ws("/", "source_rank", "pair_id").alias("row_id"), "lang", "toxic", "neutral"
    )
    lexicon = lx.lexicon_from_terms(spark, vw.per_language(vw.JUDGE_TERMS))
    rewrites = rewrite.run_baseline("delete", held, lexicon, "row_id").withColumn("experiment", F.lit("delete"))
    return evaluate.evaluate_ref(rewrites, _judge(), None, EVAL, compute_bootstrap=False).select(
        "experiment", "lang", "n_samples", "toxicity_mean", "sta", "similarity_mean", "j2_score", "bleu", "chrf"
    )


@query
def tokenize_pairs(spark, sf_dir):
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    return tk.tokenize_pairs(pairs).select(
        "pair_id", _joined("input_ids").alias("input_ids"),
        _joined("attention_mask").alias("attention_mask"), _joined("labels").alias("labels"),
    )


@query
def tokenize_inputs(spark, sf_dir):
    return tk.tokenize_inputs(vw.toxic_inputs(spark, sf_dir)).select(
        "row_id", _joined("input_ids").alias("input_ids"), _joined("attention_mask").alias("attention_mask")
    )


# --- lexicon and rewriters --------------------------------------------------




@query
def lexicon_semi_join(spark, sf_dir):
    lexicon = lx.lexicon_from_terms(spark, vw.per_language(vw.TERMS))
    return rewrite.semi_join(_vocabulary(spark, sf_dir), lexicon)


@query
def lexicon_anti_join(spark, sf_dir):
    lexicon = lx.lexicon_from_terms(spark, vw.per_language(vw.TERMS))
    return rewrite.anti_join(_vocabulary(spark, sf_dir), lexicon)


@query
def lexicon_prefix_join(spark, sf_dir):
    lexicon = lx.lexicon_from_terms(spark, vw.per_language(vw.JUDGE_TERMS))
    return rewrite.flag_vocabulary(_vocabulary(spark, sf_dir), lexicon, "prefix")


@query
def delete_exact(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rewrite.delete_inline(documents, vw.per_language(vw.TERMS), "exact").drop("text")


@query
def delete_prefix(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rewrite.delete_inline(documents, vw.per_language(vw.JUDGE_TERMS), "prefix").drop("text")


@query
def delete_builtin(spark, sf_dir):
    """Built-in terms; languages without a list of their own take the union of all lists."""
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rewrite.delete_inline(documents, BUILTIN_TERMS, "prefix").drop("text")


@query
def delete_large_lexicon(spark, sf_dir):
    """A lexicon that grows with the tables."""
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    loaded = lx.load_lexicon(vw.benchmark_terms(spark, sf_dir), ["en"])
    terms = loaded.unionByName(lx.lexicon_from_terms(spark, vw.per_language(vw.JUDGE_TERMS)))
    return rewrite.delete_terms(documents, terms.distinct(), "doc_id", "prefix").drop("text")


@query
def delete_augmented(spark, sf_dir):
    """Built-in lists, or their union, and extra terms for two languages."""
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    extra = lx.lexicon_from_terms(spark, vw.AUGMENTED_TERMS)
    return rewrite.delete_terms(documents, lx.builtin_lexicon(spark), "doc_id", "prefix", extra=extra).drop("text")


@query
def delete_baseline(spark, sf_dir):
    """The delete rewriter by its name, over pairs."""
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    lexicon = lx.lexicon_from_terms(spark, vw.per_language(vw.JUDGE_TERMS))
    return rewrite.run_baseline("delete", pairs, lexicon).select("pair_id", "lang", "prediction")


@query
def identity_baseline(spark, sf_dir):
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    return rewrite.run_baseline("identity", pairs).select("pair_id", "toxic", "neutral", "prediction")


def rule_rewriter(terms: list[str], prefix: str = "detoxify: "):
    """Loader of a stand-in for a sequence model: drops terms from a batch of prompts."""

    def load():
        known, marks = set(terms), re.compile(r"[^\w]")

        def rewrite_texts(prompts: list[str]) -> list[str]:
            texts = [p[len(prefix):] for p in prompts]
            kept = [" ".join(t for t in x.split() if marks.sub("", t.lower()) not in known) for x in texts]
            return [k or x for k, x in zip(kept, texts)]

        return rewrite_texts

    return load


@query
def rewrite_batch(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return score.rewrite_batch(documents, rule_rewriter(list(vw.TERMS))).drop("text")


# --- scorers ----------------------------------------------------------------


@query
def toxicity_lexicon(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = score.lexicon_toxicity(documents, vw.per_language(vw.TERMS))
    return scored.select(
        "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("n_flagged").cast("bigint").alias("n_flagged"),
        _round("tox_ratio").alias("tox_ratio"), _round("tox").alias("tox"),
    )


def term_classifier(terms: list[str]):
    """Loader of a stand-in for a classifier with unnamed labels."""

    def load():
        known, marks = set(terms), re.compile(r"[^\w]")

        def classify(texts: list[str]) -> list[dict[str, float]]:
            hits = [sum(marks.sub("", t.lower()) in known for t in x.split()) for x in texts]
            return [{"LABEL_0": 1 / (h + 1), "LABEL_1": h / (h + 1)} for h in hits]

        return classify

    return load


@query
def toxicity_model(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score.model_toxicity(documents, term_classifier(list(vw.TERMS)))
    return scored.select("doc_id", _round("tox").alias("tox"))


@query
def toxicity_lr(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = vw.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = score.fit_toxicity_model(documents.join(labels, "doc_id"))
    return score.score_toxicity_model(documents, model).select("doc_id", "lang", _round("tox", 4).alias("tox"))


@query
def toxicity_lr_checked(spark, sf_dir):
    """What must hold of the fitted scores: a score in range for every document, toxic ones higher on average."""
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = vw.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = score.fit_toxicity_model(documents.join(labels, "doc_id"))
    scored = score.score_toxicity_model(documents, model).join(labels, "doc_id", "left")
    by_label = lambda label: F.avg(F.when(F.col("toxic") == label, F.col("tox")))
    return scored.agg(
        F.count("tox").alias("n_scored"),
        F.sum(F.col("tox").between(0, 1).cast("bigint")).alias("n_in_range"),
        (by_label(1) > by_label(0)).alias("toxic_is_higher"),
    )


@query
def cosine_pairs(spark, sf_dir):
    vectors = vw.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = vectors.join(following, "vec_id")
    return both.select("vec_id", _round(sc.cosine(F.col("embedding"), F.col("other"))).alias("sim"))


@query
def similarity_counts(spark, sf_dir):
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    scored = score.count_similarity(pairs, "toxic", "neutral")
    return scored.select("pair_id", _round("sim").alias("sim"))


@query
def similarity_hashed(spark, sf_dir):
    pairs = ps.load_pairs(vw.doc_pairs(spark, sf_dir), list(vw.LANGS))
    scored = vectors.hashed_similarity(pairs, "toxic", "neutral")
    return scored.select("pair_id", _round("sim").alias("sim"))


@query
def hashed_vectors(spark, sf_dir):
    """Vectors of all documents, unit length in whole steps."""
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.hashed_vectors(documents, "text").select("doc_id", _joined("vector").alias("vector"))


@query
def bigram_perplexity(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents")
    model = score.BigramModel(documents)
    scored = score.bigram_perplexity(documents, model, ["doc_id"], same_corpus=True)
    return scored.select("doc_id", _round("ppl", 4).alias("ppl"))


@query
def fluency_norm(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents")
    model = score.BigramModel(documents)
    scored = score.bigram_perplexity(documents, model, ["doc_id"], same_corpus=True)
    return scored.select("doc_id", _round(sc.normalized_fluency(F.col("ppl"))).alias("fl"))


# --- evaluation -------------------------------------------------------------


@query
def join_predictions(spark, sf_dir):
    inputs = vw.toxic_inputs(spark, sf_dir)
    rewrites = vw.predictions(spark, sf_dir).select("row_id", "experiment", "prediction")
    return evaluate.join_predictions(inputs, rewrites)


def _scored(spark, sf_dir, rewrites=None):
    return evaluate.score_rows(vw.predictions(spark, sf_dir) if rewrites is None else rewrites, _judge(), _model(spark, sf_dir), EVAL)


def _row_scores(scored):
    return scored.select(
        "experiment", "row_id", "lang", _round("tox").alias("tox"), _round("sim").alias("sim"),
        _round("ppl", 4).alias("ppl"), _round("fl").alias("fl"), "sta", "sim_ok",
        _round("j2").alias("j2"), _round("j3").alias("j3"),
    )


@query
def score_rows(spark, sf_dir):
    return _row_scores(_scored(spark, sf_dir))


@query
def score_rows_all(spark, sf_dir):
    """Scores of the rewrites of all documents."""
    return _row_scores(_scored(spark, sf_dir, _all_predictions(spark, sf_dir)))


@query
def j_scores_all(spark, sf_dir):
    return evaluate.j_scores(_scored(spark, sf_dir, _all_predictions(spark, sf_dir)))


@query
def fluency_summary(spark, sf_dir):
    return evaluate.fluency_summary(_scored(spark, sf_dir))


@query
def j_scores(spark, sf_dir):
    return evaluate.j_scores(_scored(spark, sf_dir))


@query
def corpus_bleu(spark, sf_dir):
    found = grams.corpus_bleu(vw.predictions(spark, sf_dir), ["experiment", "lang"])
    return found.withColumn("bleu", _round("bleu"))


@query
def corpus_chrf(spark, sf_dir):
    found = grams.corpus_chrf(vw.predictions(spark, sf_dir), ["experiment", "lang"])
    return found.withColumn("chrf", _round("chrf"))


def _all_predictions(spark, sf_dir):
    return vw.predictions(spark, sf_dir, vw.all_inputs(spark, sf_dir))


@query
def join_predictions_all(spark, sf_dir):
    rewrites = _all_predictions(spark, sf_dir).select("row_id", "experiment", "prediction")
    return evaluate.join_predictions(vw.all_inputs(spark, sf_dir), rewrites)


@query
def corpus_bleu_all(spark, sf_dir):
    found = grams.corpus_bleu(_all_predictions(spark, sf_dir), ["experiment", "lang"])
    return found.withColumn("bleu", _round("bleu"))


@query
def corpus_chrf_all(spark, sf_dir):
    found = grams.corpus_chrf(_all_predictions(spark, sf_dir), ["experiment", "lang"])
    return found.withColumn("chrf", _round("chrf"))


@query
def evaluate_documents(spark, sf_dir):
    """The whole evaluation over all documents."""
    record = evaluate.evaluate_ref(_all_predictions(spark, sf_dir), _judge(), _model(spark, sf_dir), EVAL)
    return evaluate.flatten_ci(record)


@query
def bootstrap_ci(spark, sf_dir):
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tox = score.lexicon_toxicity(documents, vw.per_language(vw.JUDGE_TERMS), "prefix")
    found = bootstrap.bootstrap_ci(tox, ["doc_id"], ["lang"], ["tox"], BOOTSTRAP_N)
    return evaluate.flatten_ci(found)


@query
def bootstrap_small(spark, sf_dir):
    """Words per turn of every conversation: groups of a few rows."""
    turns = vw.table(spark, sf_dir, "conversations")
    sizes = turns.select("conv_id", "turn", tx.word_count(F.coalesce("text", F.lit(""))).cast("double").alias("n"))
    return evaluate.flatten_ci(bootstrap.bootstrap_ci(sizes, ["conv_id", "turn"], ["conv_id"], ["n"], BOOTSTRAP_N))


@query
def evaluate_noref(spark, sf_dir):
    record = evaluate.evaluate_noref(
        vw.predictions(spark, sf_dir).drop("neutral"), _judge(), _model(spark, sf_dir), EVAL
    )
    return evaluate.flatten_ci(record)


@query
def evaluate_noref_all(spark, sf_dir):
    """Evaluation without references over all documents."""
    rewrites = _all_predictions(spark, sf_dir).drop("neutral")
    return evaluate.flatten_ci(evaluate.evaluate_noref(rewrites, _judge(), _model(spark, sf_dir), EVAL))


@query
def evaluate_ref(spark, sf_dir):
    record = evaluate.evaluate_ref(vw.predictions(spark, sf_dir), _judge(), _model(spark, sf_dir), EVAL)
    return evaluate.flatten_ci(record)


# --- sampling by clusters ---------------------------------------------------


@query
def kmeans_clusters(spark, sf_dir):
    rows = diversity.whole_numbers(vw.table(spark, sf_dir, "embeddings"), "embedding")
    points = kmeans.points_of(rows, ["vec_id"], "embedding", None)
    found = kmeans.assign(points, ["vec_id"], kmeans.fit(points, CLUSTERS))
    return found.select("vec_id", "cluster", F.round(F.sqrt("square") / vectors.SCALE, 4).alias("dist"))


def _stepped(spark, sf_dir):
    """Vectors with their cluster after two K-means steps from the vectors of lowest id."""
    vectors = vw.table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").limit(STEP_CLUSTERS).collect()
    start = [(n, [float(x) for x in row["embedding"]]) for n, row in enumerate(first)]
    return diversity.assign_given(vectors, diversity.centroid_steps(vectors, start, STEPS))


@query
def kmeans_steps(spark, sf_dir):
    return _stepped(spark, sf_dir).select("vec_id", "cluster", _round("dist", 4).alias("dist"))


@query
def diversity_given(spark, sf_dir):
    """The row nearest to each of those centroids, topped up by a seeded sample."""
    near = diversity.nearest_rows(_stepped(spark, sf_dir), "cluster", "vec_id")
    vectors = vw.table(spark, sf_dir, "embeddings")
    more = diversity.top_up(vectors, near, SAMPLE - STEP_CLUSTERS, "vec_id")
    return near.select("vec_id").union(more)


@query
def nearest_to_centroid(spark, sf_dir):
    vectors = vw.table(spark, sf_dir, "embeddings")
    found = diversity.nearest_to_centroid(vectors, diversity.group_centroids(vectors))
    return found.select(F.col("label").cast("bigint").alias("label"), "vec_id", _round("dist").alias("dist"))


@query
def diversity_fill(spark, sf_dir):
    vectors = vw.table(spark, sf_dir, "embeddings")
    near = diversity.nearest_to_centroid(vectors, diversity.group_centroids(vectors))
    return diversity.top_up(vectors, near, SAMPLE, "vec_id")


@query
def diversity_sample(spark, sf_dir):
    vectors = vw.table(spark, sf_dir, "embeddings")
    return diversity.diversity_sample(vectors, SAMPLE, "vec_id").select("vec_id", "label")


# --- reports ----------------------------------------------------------------


def _baselines(spark, sf_dir, **options):
    rewrites = vw.predictions(spark, sf_dir)
    return evaluate.evaluate_ref(rewrites, _judge(), None, EVAL, compute_bootstrap=False, **options)


def _series(spark, sf_dir):
    """Records by method and lexicon size, and those of the identity as zero-shot of each method."""
    rewrites = vw.series_predictions(spark, sf_dir)
    # a few rows per experiment, read by every branch of a report
    records = materialize(evaluate.evaluate_noref(rewrites, _judge(), None, EVAL, compute_bootstrap=False))
    name = F.split("experiment", "_")
    is_identity = F.col("experiment") == "identity"
    few = (
        records.filter(~is_identity)
        .withColumn("method", name[0])
        .withColumn("n_shots", name[1].cast("int"))
    )
    zero = records.filter(is_identity).withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in vw.SERIES_METHODS]))
    )
    return zero, few


@query
def evaluate_by_experiment(spark, sf_dir):
    _, few = _series(spark, sf_dir)
    return few.select(
        "experiment", "lang", "method", F.col("n_shots").cast("bigint").alias("n_shots"), "n_samples",
        "toxicity_mean", "sta", "toxicity_pct_below_threshold", "similarity_mean",
        "similarity_pct_above_threshold", "j2_score",
    )


@query
def results_table(spark, sf_dir):
    return reports.results_table(_baselines(spark, sf_dir)).orderBy("lang", "experiment")


def _stored(spark, sf_dir, records, experiments):
    """Records of some experiments, saved one experiment after the other, and read back."""
    folder = f"{scratch(spark)}/results-{uuid.uuid4().hex}"
    records = materialize(records)
    for name in experiments:
        rs.save_results(records.filter(F.col("experiment") == name), folder)
    return rs.load_results(spark, folder)


@query
def results_roundtrip(spark, sf_dir):
    """Every field of the records, intervals too, after one save per experiment; by way of CSV."""
    records = evaluate.evaluate_ref(vw.predictions(spark, sf_dir), _judge(), None, EVAL)
    stored = _stored(spark, sf_dir, records, ("identity", "delete_exact", "delete_prefix"))
    flat = evaluate.flatten_ci(stored.select("_file", *records.columns))
    flat = flat.withColumn("from_json", F.col("_file").endswith(".json")).drop("_file")
    folder = f"{scratch(spark)}/summary-{uuid.uuid4().hex}"
    rs.save_summary(flat, folder)
    schema = ", ".join(f"{name} {kind}" for name, kind in flat.dtypes)
    return ps.read_files(spark, folder, "csv", schema)


@query
def results_log(spark, sf_dir):
    """A log with a batch per experiment, one saved again, one interrupted, compacted between; the latest records."""
    folder = f"{scratch(spark)}/log-{uuid.uuid4().hex}"
    records = materialize(_baselines(spark, sf_dir).select("experiment", "lang", "toxicity_mean", "similarity_mean"))
    saved = [records.filter(F.col("experiment") == name) for name in ("identity", "delete_exact", "delete_prefix")]
    rs.save_results(saved[0].withColumn("toxicity_mean", F.lit(-1.0)), folder)
    rs.save_results(saved[1], folder)
    rs.save_results(saved[0], folder)
    rs.compact_results(spark, folder)
    rs.save_results(saved[2], folder)
    rs.save_results(saved[1].withColumn("toxicity_mean", F.lit(-1.0)), folder)
    unfinished = max(n for n in files.names(spark, folder) if n.startswith("batch-"))
    files.remove(spark, f"{folder}/{unfinished}/_SUCCESS")
    return rs.load_results(spark, folder).select("experiment", "lang", "toxicity_mean", "similarity_mean")


@query
def cached_pairs(spark, sf_dir):
    """Documents per language out of a kept table: built, read again, and built anew when its source had more files."""
    folder = f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    documents = vw.table(spark, sf_dir, "documents").select("doc_id", "lang")
    documents.write.parquet(f"{folder}/in")
    steps, built = [], []
    for step in ("built", "again", "changed"):
        if step == "changed":
            documents.filter(F.col("lang") == "en").write.mode("append").parquet(f"{folder}/in")
        source = spark.read.parquet(f"{folder}/in")

        def build(source=source):
            built.append(step)
            return source.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

        kept = cache.cached_table(spark, f"{folder}/kept", build, [source], {"by": "lang"})
        steps.append(kept.select(F.lit(step).alias("step"), "lang", "n", F.lit(len(built)).cast("bigint").alias("builds")))
    return prepare.union_sources(*steps)


@query
def enrich_runs(spark, sf_dir):
    records = _baselines(spark, sf_dir).select("experiment", "lang", "toxicity_mean", "similarity_mean")
    rewrites = vw.predictions(spark, sf_dir).filter(F.col("experiment") != "identity")
    before, after = tx.word_count(F.col("toxic")), tx.word_count(F.col("prediction"))
    runs = rewrites.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_rewrites"),
        F.sum(before).cast("bigint").alias("words_in"),
        F.sum(after).cast("bigint").alias("words_out"),
    )
    enriched = reports.enrich_runs(records, runs)
    # null for experiments without a run, hence doubles
    return enriched.withColumns(
        {c: F.col(c).cast("double") for c in ("n_rewrites", "words_in", "words_out")}
    )


@query
def pending_evaluations(spark, sf_dir):
    """Planned experiments that the store holds no record of."""
    planned = vw.predictions(spark, sf_dir).select("experiment", "lang").distinct()
    stored = _stored(spark, sf_dir, _baselines(spark, sf_dir), ("identity", "delete_exact"))
    return reports.pending_evaluations(planned, stored)


@query
def sample_efficiency(spark, sf_dir):
    curve = reports.sample_efficiency(*_series(spark, sf_dir))
    return curve.withColumn("n_shots", F.col("n_shots").cast("bigint"))


@query
def method_comparison(spark, sf_dir):
    _, few = _series(spark, sf_dir)
    return reports.method_comparison(few, list(vw.SERIES_METHODS), vw.SERIES_SIZES[-1])


@query
def ablation_series(spark, sf_dir):
    _, few = _series(spark, sf_dir)
    sizes = reports.ablation_series(few, "n_shots", [1, *vw.SERIES_SIZES], {"method": "prefix"})
    methods = reports.ablation_series(
        few, "method", [*vw.SERIES_METHODS, "stem"], {"n_shots": vw.SERIES_SIZES[-1]}
    )
    return sizes.unionByName(methods)


@query
def experiment_summary(spark, sf_dir):
    zero, few = _series(spark, sf_dir)
    table = reports.experiment_summary(_baselines(spark, sf_dir), zero, few)
    return table.withColumn("n_shots", F.col("n_shots").cast("double"))


# --- flagship ---------------------------------------------------------------


@query
def detox_report(spark, sf_dir):
    """Toxic documents before and after the delete rewriter, per language."""
    terms = vw.per_language(vw.TERMS)
    rows = rewrite.delete_inline(vw.toxic_inputs(spark, sf_dir), terms, "exact")
    rows = score.lexicon_toxicity(rows, _judge(), "prefix", "text", out="tox_before")
    rows = score.lexicon_toxicity(
        rows.drop("n_tokens", "n_flagged", "tox_ratio"), _judge(), "prefix", "prediction", out="tox_after"
    )
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"),
        _round(F.avg("tox_before")).alias("tox_before"),
        _round(F.avg("tox_after")).alias("tox_after"),
        _round(F.avg(sc.success(F.col("tox_before")))).alias("sta_before"),
        _round(F.avg(sc.success(F.col("tox_after")))).alias("sta_after"),
    )
