import math

import pytest
from pyspark.sql import functions as F

from mildtext.functions import scores as sc
from mildtext.operators import evaluate, score, skew
from mildtext.operators.score import BigramModel, bigram_perplexity


def test_label_maps(spark):
    maps = [
        ({"TOXIC": 0.9, "neutral": 0.3}, 0.9), ({"neutral": 0.2}, 0.8), ({"non_toxic": 0.3}, 0.7),
        ({"LABEL_1": 0.4, "LABEL_0": 0.6}, 0.4), ({"LABEL_0": 0.6}, 0.6), ({"x": 1.0}, 0.5),
    ]
    df = spark.createDataFrame([(m, e) for m, e in maps], "m map<string,double>, e double")
    for row in df.select("e", sc.label_map_toxicity(F.col("m")).alias("t")).collect():
        assert row["t"] == pytest.approx(row["e"])


def test_fluency(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (10.0,), (1000.0,), (5000.0,), (0.5,)], "p double")
    got = [r[0] for r in df.select(sc.normalized_fluency(F.col("p"))).collect()]
    assert got[:2] == [None, None]
    assert got[2] == 1.0 and got[3] == pytest.approx(2 / 3) and got[4] == pytest.approx(0, abs=1e-12)
    assert got[5] == 0.0 and got[6] > 1


def test_cosine_and_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(sc.cosine(F.col("a"), F.col("b")), sc.euclidean(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(1 / math.sqrt(2)) and rows[0][1] == 1.0
    assert rows[1][0] == 0.0 and rows[1][1] == pytest.approx(math.sqrt(2))


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.5, 0.75, None), (0.49, 0.76, 10.0)], "tox double, sim double, ppl double")
    rows = evaluate.add_row_scores(df).collect()
    assert (rows[0]["sta"], rows[0]["sim_ok"]) == (0.0, 0.0)
    assert (rows[1]["sta"], rows[1]["sim_ok"]) == (1.0, 1.0)


def test_j_scores_and_missing_fluency(spark):
    df = spark.createDataFrame(
        [("e", "en", 0.1, 0.8, 100.0), ("e", "en", 0.9, 0.9, None), ("f", "en", 0.1, 0.8, 100.0)],
        "experiment string, lang string, tox double, sim double, ppl double",
    )
    rows = evaluate.add_row_scores(df)
    got = {r["experiment"]: r for r in evaluate.j_scores(rows).collect()}
    assert got["e"]["j2_score"] == 0.4 and got["e"]["j3_score"] is None
    assert got["f"]["j3_score"] == round(0.8 * (1 - math.log(100) / math.log(1000)), 4)
    means = {r["experiment"]: r for r in evaluate.fluency_summary(rows).collect()}
    assert means["e"]["fluency_ppl_mean"] == 100.0


def brute_perplexity(corpus, texts, k=0.1):
    pairs, ctx, vocab = {}, {}, set()
    for t in corpus:
        ws = t.lower().split()
        for a, b in zip(["<s>", *ws], ws):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            ctx[a] = ctx.get(a, 0) + 1
            vocab.add(b)
    out = []
    for t in texts:
        ws = t.lower().split()
        logs = [math.log((pairs.get((a, b), 0) + k) / (ctx.get(a, 0) + k * len(vocab))) for a, b in zip(["<s>", *ws], ws)]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_bigram_perplexity_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "SHARED_BYTES", limit)
    corpus = ["the cat sat", "the dog sat down", "The cat the cat"] + ["hot pair"] * 50
    texts = ["the cat sat down", "unseen words here", "", "hot pair hot pair"]
    train = spark.createDataFrame([("en", t) for t in corpus], "lang string, text string")
    asked = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id int, lang string, text string")
    got = {r["id"]: r["ppl"] for r in bigram_perplexity(asked, BigramModel(train), ["id"]).collect()}
    for i, want in enumerate(brute_perplexity(corpus, texts)):
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_count_similarity(spark):
    df = spark.createDataFrame(
        [(1, "A b b", "a B b"), (2, "x", "y"), (3, "", "y"), (4, "", ""), (5, "a a", "a b")],
        "id int, l string, r string",
    )
    got = {r["id"]: r["sim"] for r in score.count_similarity(df, "l", "r").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == got[3] == got[4] == 0.0
    assert got[5] == pytest.approx(2 / (2 * math.sqrt(2)))


def test_outside_models(spark):
    df = spark.createDataFrame([(i, f"text {i}", "text") for i in range(10)], "id int, a string, b string")

    def load_embedding():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    sims = score.model_similarity(df, load_embedding, "a", "b", batch_size=3).collect()
    assert len(sims) == 10 and all(0 < r["sim"] <= 1 for r in sims)

    def load_lm():
        return lambda texts: [None if t.endswith("3") else float(len(t)) for t in texts]

    ppl = {r["id"]: r["ppl"] for r in score.model_perplexity(df, load_lm, "a").collect()}
    assert ppl[3] is None and ppl[4] == 6.0

    def load_seq():
        def run(prompts):
            assert len(prompts) <= 4
            return [p.removeprefix("detoxify: ").upper() for p in prompts]

        return run

    out = {r["id"]: r["prediction"] for r in score.rewrite_batch(df, load_seq, "a", batch_size=4).collect()}
    assert out[7] == "TEXT 7"


def test_toxicity_model_learns(spark):
    rows = [(i, "you idiot fool" if i % 3 == 0 else "a nice day", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, toxic int")
    model = score.fit_toxicity_model(df)
    got = score.score_toxicity_model(df, model).groupBy("toxic").agg(F.avg("tox")).collect()
    means = {r[0]: r[1] for r in got}
    assert means[1] > 0.8 > 0.2 > means[0]
