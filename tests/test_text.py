import re

import pytest
from pyspark.sql import functions as F

from mildtext.functions import text as tx

SAMPLES = [
    "", " ", " ", "a", " a  b ", " x\u0085y\u001cz ", "Hello, WORLD!", "don't...stop",
    "hey ... idiot", "कुत्ता पागल", "İstanbul ÄÖ_1 ½", "tab\tnew\nline\r\n end\n",
    "　wide space line", "😀 ok😀 ",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")
    flat = tx.collapse(F.col("t"))
    return {
        r["i"]: r
        for r in df.select(
            "i", tx.strip(F.col("t")).alias("strip"), tx.collapse(F.col("t")).alias("flat"),
            tx.words(F.col("t")).alias("words"), tx.word_count(F.col("t")).alias("n"),
            tx.raw_tokens(flat).alias("raw"), tx.clean_tokens(flat).alias("clean"),
            tx.without_space(F.col("t")).alias("chars"), tx.first_words(F.col("t"), 2).alias("two"),
        ).collect()
    }


@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_same_as_python_strings(rows, i):
    text, row = SAMPLES[i], rows[i]
    assert row["strip"] == text.strip()
    assert row["words"] == text.split()
    assert row["n"] == len(text.split())
    assert row["flat"] == " ".join(text.split())
    assert row["two"] == text.split()[:2]
    assert row["chars"] == "".join(text.split())
    tokens = text.split() or [""]
    assert row["raw"] == tokens
    assert row["clean"] == [re.sub(r"[^\w]", "", t.lower()) for t in tokens]


def test_13a_tokens(spark):
    cases = {
        "Hello, world!": ["Hello", ",", "world", "!"],
        "It costs 1,000.50 now.": ["It", "costs", "1,000.50", "now", "."],
        "a &amp; b &lt;c&gt;": ["a", "&", "b", "<", "c", ">"],
        "1990-2000 up-to": ["1990", "-", "2000", "up-to"],
        "line\nbreak hy-\nphen": ["line", "break", "hyphen"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", tx.flat_13a(F.col("t")).alias("w")).collect():
        assert row["w"].split(" ") == cases[row["t"]]


def test_first_filled_skips_null_and_empty(spark):
    df = spark.createDataFrame([(None, "", "c"), ("", " ", "c"), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(tx.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["c", " ", ""]


def test_normalize_lang(spark):
    df = spark.createDataFrame([(" ES-mx",), ("hi",), ("",)], "l string")
    assert [r[0] for r in df.select(tx.normalize_lang(F.col("l"))).collect()] == ["es", "hi", ""]
