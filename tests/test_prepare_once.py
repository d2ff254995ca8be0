"""How often the preparation reads and makes its texts."""

import time

from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.plans import prepare_all as pa


def test_strip_reads_only_the_ends(spark):
    # a pattern that looks for blanks at the end tries every blank of the run: 200,000 squared steps
    text = F.concat(F.lit(" \n a"), F.repeat(F.lit(" "), 200_000), F.lit("b \x1c　"))
    began = time.time()
    got = spark.range(1).select(tx.strip(text).alias("s")).first()["s"]
    assert got == "a" + " " * 200_000 + "b" and time.time() - began < 20


def test_preparation_makes_its_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text number {i % 50}"

    source = spark.range(100).select(
        F.col("id").alias("pair_id"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(0).alias("source_rank"),
        text("id").alias("toxic"), F.lit("some text").alias("neutral"),
    )
    assert len(pa.prepare_pairs([source]).collect()) == 50
    assert made.value == 100
