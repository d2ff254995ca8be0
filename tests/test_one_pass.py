"""Scoring of rewrites: texts are read once, equal ones are counted once, and rows are those of the forms it replaced."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mildtext.operators import bigrams, bootstrap, evaluate, grams, score
from mildtext.operators import rewrite as rw
from mildtext.plans import views as vw
from tests.test_rewrite import TERMS, TEXTS
from tests.test_shapes import ODD

SHAPE = "row_id long, experiment string, lang string, toxic string, prediction string, neutral string"
WORDS = {"en": ["idiot", "mother"], "es": ["tonto"]}


def odd_texts(spark):
    # letters, numbers and marks beyond ASCII, a letter newer than the engine's tables, lower case of another length
    more = ["İDIOT ΣΑΣ idiot́ id­iot mor٣on", "\U0001e4d0idiot \U00031350 ⅷ ² _idiot_ ᠎idiot", "i.d.i.o.t IDİOT Motherʼs"]
    texts = [*TEXTS, ("en", None), (None, None), *[(lang, t) for t in [*ODD, *more] for lang in ("en", "es", "zz")]]
    return spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, lang string, text string")


@pytest.mark.parametrize("keep_marks", [False, True])
def test_several_lists_at_once(spark, keep_marks):
    df = odd_texts(spark)
    lists = {"a": (TERMS, "prefix"), "b": (TERMS, "exact"), "c": ({"es": ["idiot", ""], "zz": ["moth"]}, "prefix")}
    got = rw.delete_each(df, lists, keep_marks=keep_marks)
    assert got.columns == ["id", "lang", "text", "a", "b", "c"]
    want = df
    for name, (terms, match) in lists.items():
        want = rw.delete_inline(want, terms, match, out=name, keep_marks=keep_marks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tokens_of_many_words_are_forgotten(spark, monkeypatch):
    monkeypatch.setattr(rw, "REMEMBERED", 3)
    flags = rw.flags_by_scope(spark.createDataFrame([("a",)], "text string"), [(TERMS, "prefix"), (TERMS, "exact")])()("en")
    assert [flags[t] for t in ["idiot", "idiots!", "fine", "moro", "fine", "idiot"]] == [3, 1, 0, 1, 0, 3] and len(flags) <= 3


@pytest.mark.parametrize("match", ["exact", "prefix"])
def test_hits_are_counted_beside_the_overlaps(spark, match):
    df = odd_texts(spark)
    asked = df.withColumn("prediction", F.col("text")).withColumn("toxic", F.col("text"))
    got = grams.add_overlaps(asked, (rw.flags_by_scope(df, [(TERMS, match)]), "lang"), term=("toxic", "prediction"))
    got = score.lexicon_toxicity_counted(got).select("id", "n_tokens", "n_flagged", "tox_ratio", "tox")
    want = score.lexicon_toxicity(df, TERMS, match).select("id", "n_tokens", "n_flagged", "tox_ratio", "tox")
    assert dict(got.dtypes) == dict(want.dtypes)
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


ROWS = [
    (1, "e", "en", "you idiot here", "you here", "you here"), (1, "f", "en", "you idiot here", "you idiot here", "you here"),
    (2, "e", "es", "un tonto", "un tonto", "un"), (2, "e", "en", "a b", "a b b", "a"), (3, "e", "en", "twice a b", "twice a b", "a"),
    (3, "e", "en", "twice a b", "a b", None), (None, "e", "en", "a b", "a b", "a"), (None, "e", "en", "a b", "a b", "a"),
    (4, None, "en", "b a", "b a", "a"), (5, "e", None, "a b", "a b", "a"), (6, "e", "en", "a", None, "a"), (7, "e", "en", None, " ", "a"),
    (8, "e", "fr", "a b", "a b", "a b"),
]
CORPUS = [("en", "a b a b c"), ("en", "you idiot here"), ("es", "un tonto"), (None, "a b")]


@pytest.mark.parametrize("with_references", [False, True])
def test_rows_are_those_of_a_join_by_keys(spark, with_references):
    df = spark.createDataFrame(ROWS, SHAPE)
    model = score.BigramModel(spark.createDataFrame(CORPUS, "lang string, text string"))
    got = evaluate.score_rows(df, WORDS, model, with_references=with_references)
    kinds = {"term": ("toxic", "prediction")} | ({k: ("prediction", "neutral") for k in ("word", "char")} if with_references else {})
    rows = grams.add_overlaps(score.lexicon_toxicity(df, WORDS, "prefix", text="prediction"), **kinds).withColumn("sim", grams.term_cosine())
    rows = rows.select(*evaluate.KEYS, "lang", "tox", "sim", *[k for k in kinds if k != "term"])
    ppl = score.bigram_perplexity(df, model, evaluate.KEYS, text="prediction")
    want = evaluate.add_row_scores(rows.join(ppl, evaluate.KEYS, "left"))
    assert got.columns == want.columns
    plain = lambda x: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.collect())
    assert plain(got) == plain(want)


def test_predictions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(ROWS, SHAPE).mapInArrow(count, SHAPE)
    model = score.BigramModel(spark.createDataFrame(CORPUS, "lang string, text string"))
    evaluate.evaluate_ref(df, WORDS, model).collect()
    assert made.value == len(ROWS)


def test_rewriters_are_one_function_call(spark):
    plan = vw.predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_equal_texts_of_a_chunk_are_kept_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "en", "a b  a" if i % 2 else "A b a") for i in range(20)], "id int, lang string, text string").coalesce(1)
    monkeypatch.setattr(bigrams, "CHUNK_BYTES", 8)  # one text is 5
    own = bigrams.chunks(rows, ["id"], "text", "lang").collect()
    assert len(own) == 1 and len(bigrams._unsqueezed(own[0]["ids"])) == 3
    chunk = bigrams._Chunk("en", *(bytes(own[0][c]) for c in ("words", "ids", "sizes", "texts")))
    # (start, a), (a, b), (b, a), and start, a, b as contexts: each is in all texts
    assert sorted(chunk.amounts.tolist()) == [20] * 6 and len(chunk.texts) == 20
    monkeypatch.setattr(bigrams, "CHUNK_ROWS", 7)
    assert sorted(len(r["key0"]) for r in bigrams.chunks(rows, ["id"], "text", "lang").collect()) == [6, 7, 7]


def test_equal_pairs_are_counted_once(monkeypatch):
    asked = []
    count = grams.count_overlap
    monkeypatch.setattr(grams, "count_overlap", lambda left, right, *a: asked.append(len(left)) or count(left, right, *a))
    left, right = ["a  b", None, "a b", "b", "a b"], ["a b", "a b", " a b", "a", None]
    got = grams._counted("word", left, right)
    assert asked == [3]
    sides = [(a, b or "") for a, b in zip(["a b", "a b", "a b", "b", "a b"], ["a b", "a b", "a b", "a", ""])]
    want = count([a for a, _ in sides], [b for _, b in sides], grams.WORD_ORDER, False)
    assert got.to_numpy().tolist() == want.to_numpy().tolist() and got.index.tolist() == list(range(5))


def test_digests_of_many_keys(monkeypatch):
    keys = [f"e|{i}" for i in range(300)] + ["", "é|1", "x" * 30, *["y" * n for n in range(44, 70)], "z" * 200]
    bounds = np.array([int(b, 16) for b in bootstrap.poisson_bounds()])
    want = []
    for key in keys:
        raw = b"".join(hashlib.md5(f"42|{key}|{block}".encode()).digest() for block in range(math.ceil(1001 / 4)))
        want.append(np.searchsorted(bounds, np.frombuffer(raw, ">u4").astype(np.int64), side="right")[:1001])
    one_by_one = []
    md5 = hashlib.md5
    monkeypatch.setattr(bootstrap.hashlib, "md5", lambda raw: one_by_one.append(raw) or md5(raw))
    assert (bootstrap.draws(keys, 1001, 42) == np.array(want)).all()
    # only messages of several blocks
    assert len(one_by_one) < 25
    assert bootstrap.draws([], 10, 1).shape == (0, 10)
