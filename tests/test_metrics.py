import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mildtext.operators import bootstrap, diversity, evaluate, grams, reports
from mildtext.operators.score import BigramModel, bigram_perplexity
from mildtext.sources import results as rs


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, prediction string, neutral string").withColumn("g", F.lit("x"))


def bleu(spark, rows):
    return grams.corpus_bleu(frame(spark, rows), ["g"]).collect()[0]["bleu"]


def chrf(spark, rows):
    return grams.corpus_chrf(frame(spark, rows), ["g"]).collect()[0]["chrf"]


def brute_bleu(rows):
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for _, h, r in rows:
        h, r = h.split(), r.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            a = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            b = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    if not any(match):
        return 0.0
    logs, smooth = [], 1.0
    for m, t in zip(match, total):
        if t == 0:
            break
        if m == 0:
            smooth *= 2
            logs.append(math.log(100 / (smooth * t)))
        else:
            logs.append(math.log(100 * m / t))
    penalty = math.exp(1 - ref_len / hyp_len) if hyp_len < ref_len else 1.0
    return penalty * math.exp(sum(logs) / len(logs))


def brute_chrf(rows):
    stats = [[0, 0, 0] for _ in range(6)]
    for _, h, r in rows:
        h, r = "".join(h.split()), "".join(r.split())
        for n in range(1, 7):
            a = Counter(h[i:i + n] for i in range(len(h) - n + 1))
            b = Counter(r[i:i + n] for i in range(len(r) - n + 1))
            stats[n - 1][0] += sum(a.values()) if b else 0
            stats[n - 1][1] += sum(b.values())
            stats[n - 1][2] += sum((a & b).values())
    used = [(m / a, m / b) for a, b, m in stats if a and b]
    if not used:
        return 0.0
    p, r = (sum(x) / len(used) for x in zip(*used))
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


CORPORA = [
    [(1, "the cat sat on the mat", "the cat sat on the mat")],
    [(1, "the cat sat on the mat", "a dog ran by")],
    [(1, "the the the the", "the cat"), (2, "a small test case here", "a small test case there")],
    [(1, "short", "a much longer reference text than that")],
    [(1, "one two", "one two three")],
    [(1, "x", "y"), (2, "", "words"), (3, "words", "")],
    [(1, "naïve 😀 café über", "naive 😀 café uber")],
    [(1, "abc", "ab"), (2, "ab", "abcdefgh")],
]


@pytest.mark.parametrize("rows", CORPORA)
def test_corpus_scores_against_brute_force(spark, rows):
    assert bleu(spark, rows) == pytest.approx(brute_bleu(rows))
    assert chrf(spark, rows) == pytest.approx(brute_chrf(rows))


def test_hand_worked_values(spark):
    assert bleu(spark, CORPORA[0]) == pytest.approx(100) and chrf(spark, CORPORA[0]) == pytest.approx(100)
    assert bleu(spark, [(1, "a b c d", "e f g h")]) == 0 and chrf(spark, [(1, "abcd", "efgh")]) == 0
    # 5/6, 3/5, 1/4 and a smoothed 1/(2*3) out of 6 words each
    rows = [(1, "the cat sat on a mat", "the cat lay on a mat")]
    want = 100 * (5 / 6 * 3 / 5 * 1 / 4 * 1 / 6) ** 0.25
    assert bleu(spark, rows) == pytest.approx(want)


def test_overlap_needs_no_shuffle(spark):
    df = grams.add_overlap(frame(spark, CORPORA[2]), "char", "prediction", "neutral")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_overlap_in_small_portions(monkeypatch):
    left = ["a b a", "", "x", "a b", "long text with many words"] * 7
    right = ["a a c", "y", "", "a b", "long text with words"] * 7
    whole = grams.count_overlap(left, right, 4, False)
    one_by_one = [grams.count_overlap([a], [b], 4, False) for a, b in zip(left, right)]
    assert whole.equals(pd.concat(one_by_one, ignore_index=True))
    assert whole.iloc[0]["match_1"] == 2 and whole.iloc[0]["ab"] == 4


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, "c", 0.25) for i in range(20)] + [(i, "u", i / 600) for i in range(600)], "id int, g string, x double")
    got = {r["g"]: r["x_ci"] for r in bootstrap.bootstrap_ci(rows, ["id"], ["g"], ["x"]).collect()}
    assert (got["c"]["lower"], got["c"]["mean"], got["c"]["upper"]) == (0.25, 0.25, 0.25)
    se = 1 / math.sqrt(12 * 600)
    assert got["u"]["lower"] == pytest.approx(got["u"]["mean"] - 1.96 * se, abs=0.004)
    assert got["u"]["upper"] == pytest.approx(got["u"]["mean"] + 1.96 * se, abs=0.004)
    assert bootstrap.bootstrap_ci(rows.filter("x > 9"), ["id"], ["g"], ["x"]).count() == 0


def test_small_groups_are_drawn_with_replacement(spark):
    pick = random.Random(4)
    rows = [(i, g, h, float(pick.randint(0, 9))) for i, (g, h) in enumerate((g, h) for g in ("a", None, "b") for h in (1, 2) for _ in range(3 + 9 * h))]
    rows += [(1000, "one", 1, 7.0), (1001, "null", 1, None)]
    df = spark.createDataFrame(rows, "id int, g string, h int, x double").repartition(5)
    got = {(r["g"], r["h"]): r["x_ci"] for r in bootstrap.bootstrap_ci(df, ["id"], ["g", "h"], ["x"], 400).collect()}
    assert len(got) == 8
    for (g, h), ci in got.items():
        own = [x or 0.0 for _, its, k, x in rows if (its, k) == (g, h)]
        drawn = bootstrap.row_draws("|".join(str(v) for v in (g, h) if v is not None), len(own), 400, 42)
        assert drawn.shape == (400, len(own)) and drawn.min() >= 0 and drawn.max() < len(own)
        means = np.array(own)[drawn].mean(axis=1)
        assert (ci["lower"], ci["upper"]) == tuple(round(float(p), 4) for p in np.percentile(means, [2.5, 97.5]))
        # an independent resampling agrees
        own_way = [sum(pick.choices(own, k=len(own))) / len(own) for _ in range(4000)]
        spread = max(0.2, 3 * np.std(own_way) / 5)
        assert ci["lower"] == pytest.approx(np.percentile(own_way, 2.5), abs=spread)
        assert ci["upper"] == pytest.approx(np.percentile(own_way, 97.5), abs=spread)


def test_poisson_weights_have_mean_and_variance_one():
    weights = bootstrap.draws([str(i) for i in range(200)], 100, 42)
    assert weights.shape == (200, 100)
    assert weights.mean() == pytest.approx(1, abs=0.03) and weights.var() == pytest.approx(1, abs=0.05)


def test_bootstrap_is_an_explicit_resampling(spark):
    rows = [(i, "ab"[i % 3 == 0], i / 7 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(4)
    got = {(r["g"], r["replicate"]): r["x"] for r in bootstrap.replicate_means(df, ["id"], ["g"], ["x"], 9).collect()}
    weights = bootstrap.draws([str(i) for i, _, _ in rows], 9, 42)
    for (g, rep), x in got.items():
        own = [(weights[n, rep], v or 0.0) for n, (_, group, v) in enumerate(rows) if group == g]
        assert x == pytest.approx(sum(w * v for w, v in own) / sum(w for w, _ in own))
    assert len(got) == 18
    plan = bootstrap.replicate_means(df, ["id"], ["g"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_language_without_a_model_has_no_perplexity(spark):
    corpus = spark.createDataFrame([("en", "a b c a b"), ("en", "b a")], "lang string, text string")
    asked = [(1, "en", "a b"), (2, "hi", "a b"), (3, "en", ""), (4, "en", "z z a"), (5, None, "a"), (6, "en", None)]
    df = spark.createDataFrame(asked, "row_id int, lang string, text string")
    model = BigramModel(corpus)
    got = {r["row_id"]: r["ppl"] for r in bigram_perplexity(df, model, ["row_id"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[2] is None and got[3] is None and got[5] is None and got[6] is None
    v, k = 3, 0.1
    p = lambda c12, c1: (c12 + k) / (c1 + k * v)
    assert got[1] == pytest.approx(math.exp(-(math.log(p(1, 2)) + math.log(p(2, 2))) / 2))
    assert got[4] == pytest.approx(math.exp(-(math.log(p(0, 2)) + 2 * math.log(p(0, 0))) / 3))
    rows = df.filter("row_id = 2").select("row_id", F.lit("e").alias("experiment"), "lang", F.col("text").alias("toxic"), F.col("text").alias("prediction"))
    record = evaluate.evaluate_noref(rows, {"en": ["idiot"]}, model, compute_bootstrap=False).collect()[0]
    assert record["fluency_norm_mean"] is None and record["j3_score"] is None


def test_overlaps_take_one_pass(spark):
    df = spark.createDataFrame([(1, "e", "en", "a b", "a", "b")], "row_id int, experiment string, lang string, toxic string, prediction string, neutral string")
    rows = evaluate.score_rows(df, {"en": ["idiot"]}, None, with_references=True)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_identity_scores(spark):
    rows = [(i, "identity", "en", f"some text number {i}", f"some text number {i}", f"some text number {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "row_id int, experiment string, lang string, toxic string, prediction string, neutral string")
    model = BigramModel(df.select("lang", F.col("toxic").alias("text")))
    record = evaluate.evaluate_ref(df, {"en": ["idiot"]}, model).collect()[0]
    assert record["similarity_mean"] == 1.0 and record["sta"] == 1.0 and record["bleu"] == 100.0 and record["chrf"] == 100.0
    assert record["j3_score"] <= record["j2_score"]
    assert record["similarity_ci"]["lower"] == record["similarity_ci"]["upper"] == 1.0
    plain = evaluate.evaluate_noref(df.drop("neutral"), {"en": ["idiot"]}, None, compute_bootstrap=False).collect()[0]
    assert plain["bleu"] is None and plain["fluency_ppl_mean"] is None and plain["j3_score"] is None


def test_diversity_sample(spark):
    points = [(i, "en", [float(i % 5) * 10 + (i // 5) * 0.01, 0.0]) for i in range(50)]
    df = spark.createDataFrame(points, "pair_id long, lang string, embedding array<float>")
    picked = [r["pair_id"] for r in diversity.diversity_sample(df, 5, n_init=2).collect()]
    assert len(picked) == len(set(picked)) == 5 and {i % 5 for i in picked} == set(range(5))
    assert diversity.diversity_sample(df, 50).count() == 50
    assert diversity.diversity_sample(df.drop("embedding"), 7).count() == 7
    same = df.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(1.0).cast("float")))
    topped = [r["pair_id"] for r in diversity.diversity_sample(same, 6, n_init=1).collect()]
    assert len(topped) == len(set(topped)) == 6


def test_results_round_trip(spark, tmp_path):
    records = spark.createDataFrame(
        [("a", "en", 0.1, None, (0.1, 0.0, 0.2)), ("a", "es", 0.2, None, (0.2, 0.1, 0.3))],
        f"experiment string, lang string, toxicity_mean double, bleu double, toxicity_ci {rs.CI}",
    )
    rs.save_results(records, str(tmp_path / "r"))
    back = rs.load_results(spark, str(tmp_path / "r"))
    assert dict(back.dtypes)["bleu"] == "double" and back.count() == 2
    assert back.filter("lang = 'es'").collect()[0]["toxicity_ci"]["upper"] == 0.3
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "b_eval.json").write_text('{\n  "experiment": "b",\n  "lang": "hi",\n  "bleu": null\n}')
    (tmp_path / "ref" / "other.json").write_text("{}")
    one = rs.load_results(spark, str(tmp_path / "ref"), "*_eval.json", indented=True).collect()
    assert [(r["experiment"], r["_file"]) for r in one] == [("b", "b_eval.json")]


def test_reports(spark):
    schema = "experiment string, lang string, method string, n_shots int, toxicity_mean double, toxicity_pct_below_threshold double, similarity_mean double, bleu double"
    base = spark.createDataFrame([("baseline", "en", None, None, 0.5, 50.0, 0.9, 40.0)], schema)
    zero = spark.createDataFrame([("zero", "en", "m", None, 0.4, 60.0, 0.8, None)], schema)
    few = spark.createDataFrame([("few50", "en", "m", 50, 0.3, 70.0, 0.7, None), ("few200", "en", "m", 200, 0.2, 80.0, 0.6, None)], schema)
    summary = reports.experiment_summary(base, zero, few).collect()
    assert [(r["method"], r["n_shots"]) for r in summary] == [("baseline", None), ("m", 0), ("m", 50), ("m", 200)]
    assert summary[0]["bleu"] == 40.0 and summary[1]["bleu"] is None
    curve = reports.sample_efficiency(zero, few).collect()
    assert [r["n_shots"] for r in curve] == [0, 50, 200]
    wide = reports.method_comparison(few, ["m", "other"]).collect()[0]
    assert wide["m_toxicity"] == 0.2 and wide["other_toxicity"] is None
    series = reports.ablation_series(few, "n_shots", [50, 100], {"method": "m"}).collect()
    assert {r["value"]: r["toxicity_mean"] for r in series} == {"50": 0.3, "100": None}
    pending = reports.pending_evaluations(few.select("experiment", "lang"), few.filter("n_shots = 50"))
    assert [r["experiment"] for r in pending.collect()] == ["few200"]
    table = reports.results_table(base.drop("bleu")).collect()[0]
    assert table["bleu"] is None and table["sta_pct"] == 50.0
