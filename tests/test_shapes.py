"""Shapes of texts in Python workers."""

import pytest
from pyspark.sql import functions as F

from mildtext.functions import shapes
from mildtext.functions import text as tx
from mildtext.operators import grams
from tests.test_text import SAMPLES

ODD = [
    *SAMPLES, "a-\nb <skipped>x &lt;i&gt; &amp;quot; 1,000.5-6 ... ,.a.,b 9.", "..", ".,.,.", "-5- 5-5--", "\r\n.\r", "x . ",
    "[{}]~`!@#$%^&*()_+=|\\:;\"'<>?/", "1.a.1.é.😀.", "skip\x1f-\n\x1dx ", "\x85 \x0b-\n\n-\n",
]


def test_shapes_are_those_of_the_expressions(spark):
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    rows = df.select("t", tx.flat_13a(t).alias("word"), tx.without_space(t).alias("char"), tx.collapse(t).alias("term")).collect()
    texts = [r["t"] for r in rows]
    for kind, shape in grams.SHAPES.items():
        assert shape(texts) == [r[kind] for r in rows]


@pytest.mark.parametrize("kinds", [{"word": ("l", "r")}, {"term": ("l", "r"), "word": ("r", "l"), "char": ("r", "l")}])
def test_texts_go_to_python_as_they_are(spark, kinds):
    df = spark.createDataFrame([("a b.", "a  b"), (None, "x"), ("x", None), (None, None), ("é é", "é é")], "l string, r string")
    found = grams.add_overlaps(df, **kinds)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    for kind, (left, right) in kinds.items():
        # as for texts that are equal: null on one side is an empty text, on both sides too
        shape = {"word": tx.flat_13a, "char": tx.without_space, "term": lambda c: tx.collapse(F.lower(c))}[kind]
        sides = df.select(*[F.coalesce(shape(F.col(c)), F.lit("")) for c in (left, right)]).collect()
        want = grams.count_overlap([s[0] for s in sides], [s[1] for s in sides], grams.ORDERS[kind], kind == "char")
        assert [tuple(r[kind]) for r in found.collect()] == [tuple(x) for x in want.to_numpy().tolist()]
