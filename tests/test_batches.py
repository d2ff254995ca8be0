"""What Python workers get at once, and equal stretches in the overlap of two texts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mildtext.operators import grams, score
from mildtext.session import BATCH_BYTES


def test_batches_are_bounded_by_bytes(spark):
    def load():
        return lambda texts: [str(sum(map(len, texts)))] * len(texts)

    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("text "), 2000).alias("text"))
    sizes = score.apply_model(rows, load, ["text"], "size", "string", batch_size=1 << 30)
    # 20 MB of text in one task
    assert 0 < sizes.agg(F.max(F.col("size").cast("bigint"))).first()[0] <= 2 * BATCH_BYTES


def counted(left, right, orders, chars):
    """Plain counting of multisets."""
    from collections import Counter

    out = []
    for a, b in zip(left, right):
        x, y = (list(t) if chars else t.split(" ") if t else [] for t in (a, b))
        row = []
        for n in range(1, orders + 1):
            u, v = (Counter(tuple(z[i : i + n]) for i in range(len(z) - n + 1)) for z in (x, y))
            row += [u.total(), v.total(), (u & v).total()]
        u, v = Counter(x), Counter(y)
        row += [sum(u[k] * v[k] for k in u), sum(n * n for n in u.values()), sum(n * n for n in v.values())]
        out.append(row)
    return pd.DataFrame(out)


@pytest.mark.parametrize("orders, chars", [(1, False), (1, True), (4, False), (6, True)])
def test_overlap_of_edited_texts(orders, chars):
    random.seed(5)
    left, right = [], []
    for _ in range(400):
        units = [random.choice("abé\U0001f600" if random.random() < 0.5 else "ab") for _ in range(random.choice([0, 1, 3, 9, 80, 300]))]
        edited = [u for u in units if random.random() > 0.05] if random.random() < 0.9 else units[::-1]
        for side, part in ((left, units), (right, edited)):
            side.append(("" if chars else " ").join(part))
    got = grams.count_overlap(left, right, orders, chars)
    assert got.to_numpy().tolist() == counted(left, right, orders, chars).to_numpy().tolist()


def test_equal_texts_are_not_counted(monkeypatch):
    sizes = []
    unique = grams.np.unique
    monkeypatch.setattr(grams.np, "unique", lambda x, **k: sizes.append(len(x)) or unique(x, **k))
    text = "some words in a text that is long " * 500
    grams.count_overlap([text], [text.replace("that is long words", "")], 6, True)
    grams.count_overlap([text], [text], 6, True)
    assert sum(sizes) < len(text) / 10


def test_null_sides(spark):
    rows = [(1, None, None), (2, None, "a b"), (3, "a b", None), (4, "a  b\n", "a b"), (5, "a b", "a b")]
    df = spark.createDataFrame(rows, "id int, l string, r string")
    got = {r["id"]: r["word"] for r in grams.add_overlap(df, "word", "l", "r").collect()}
    assert [(got[i]["left_1"], got[i]["right_1"], got[i]["match_2"]) for i in range(1, 6)] == [(0, 0, 0), (0, 2, 0), (2, 0, 0), (2, 2, 1), (2, 2, 1)]
