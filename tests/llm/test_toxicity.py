import math
import random
import re
import zlib

import numpy as np
import pytest

from mildtext.llm import toxicity
from mildtext.llm.queries import op5_toxicity

LEXICON = ["idiot", "scum", "moron"]


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    order = s.argsort(kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        rank[s == v] = np.flatnonzero(s[order] == v).mean() + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_fold():
    assert toxicity.fold("1D10T!! Ｓtupíd, sсum; 3 100 trash### a$s no!") == " idiot stupíd scum trash ass no "
    assert toxicity.fold("") == "  "
    assert toxicity.fold("12 34 -") == "  "
    assert toxicity.Model({" idiot ": 2.0, " idio": 1.0}).hits(toxicity.fold("an ídiöt, ídiom")) == {3: 2.0}


def test_hits_are_those_of_brute_force():
    pick = random.Random(1)
    words = ["idiot", "idiotic", "scum", "scummy", "the", "pond", "id", "moron"]
    model = toxicity.Model({" idiot": 2.0, " idiot ": 3.0, " scum ": 1.5, " moro": 1.0}, [" pond scum ", " the idiot "])
    for _ in range(300):
        text = " " + " ".join(pick.choices(words, k=pick.randint(0, 12))) + " "
        want = {}
        for m in re.finditer(r" (?=[a-z])", text):
            fits = [w for t, w in model.weights.items() if text.startswith(t, m.start())]
            if fits:
                want[m.start()] = max(fits)
        for phrase in model.phrases:
            for m in re.finditer(f"(?={phrase})", text):
                for at in [a for a in want if m.start() <= a < m.start() + len(phrase) - 1]:
                    del want[at]
        assert model.hits(text) == want


@pytest.fixture(scope="module")
def model_and_rows(spark):
    pick = random.Random(7)
    rows = []
    for i in range(900):
        words = pick.choices([f"w{chr(97 + a)}{chr(97 + b)}x" for a in range(9) for b in range(9)], k=pick.randint(5, 80))
        toxic = i % 4 == 0
        if toxic:
            words[:: max(1, len(words) // 4)] = [pick.choice(LEXICON)] * len(words[:: max(1, len(words) // 4)])
        elif i % 27 == 0:
            words += ["pond", "scum"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels), rows


def test_learned(model_and_rows):
    model, rows = model_and_rows
    assert {f" {w} " for w in LEXICON[:1]} <= set(model.weights)
    out = [(model.score(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert auc(*zip(*out)) > 0.99
    assert np.mean([(s >= 0.7) == bool(y) for s, y in out]) > 0.97
    assert model.score("wabx wacx you 1d1ot m0r0n " + "idiot " * 3) > 0.7
    assert " pond scum " in model.phrases


def test_edge_rows(spark, model_and_rows):
    model, _ = model_and_rows
    docs = spark.createDataFrame(
        [(1, None, 9.0), (None, "idiot", 9.0), (2, "", 9.0), (2, "", 9.0), (3, "idiot " * 100_000, 9.0)], "doc_id long, text string, score double"
    )
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "score", "predicted"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, toxic int, text int"))
    assert not none.weights and 0 < none.score("idiot") < 0.7
    assert math.isfinite(none.score(None))


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 10_000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    out = got[got.held_out].merge(labels, on="doc_id")
    assert auc(out.score, out.toxic) > 0.95
    kept = out[out.predicted == 1]
    assert (kept.toxic == 1).mean() > 0.95 and len(kept) > 0.8 * out.toxic.sum()
