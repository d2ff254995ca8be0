"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Counts of a text come out of one projection over arrays, without a shuffle.  Each rule
compares one share with a cutoff from a fixed grid.  On labelled good documents the exact
binomial test decides, stratum by stratum, whether a cutoff's false rejections are surely
below the allowed share: cutoffs are tried from lenient to strict and the trial of a rule
ends at its first failure (fixed-sequence testing); rules and strata share the error by
Bonferroni.  What is not certified rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.llm.common import written
from mildtext.session import sized

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
# Rules by name: (count, base); a text is rejected if 100 * count >= cutoff * base.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "not_distinct": ("n_not_distinct", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_not_distinct")


@dataclass(frozen=True)
class Risk:
    """``share``: good documents of a stratum that all rules together may reject at most, with
    probability ``1 - error`` over all strata; ``cutoffs`` in percent."""

    share: float = 0.05
    error: float = 0.05
    cutoffs: tuple[int, ...] = (100, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15, 10, 5)


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _nth(array: Column, i: Column) -> Column:
    return F.get(array, i)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and :data:`COUNTS` (long).

    A null text has no words.  Word windows are told apart by a 64-bit digest within one
    text.  Columns of ``docs`` with the names of the counts are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, *COUNTS)]
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    bare = F.btrim(text, F.lit(_SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, _SPACES) != "")
    df = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(bare != "", F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")).alias("__words"),
        F.when(text.contains("\n"), lines).otherwise(F.when(bare != "", F.array(text)).otherwise(F.array().cast("array<string>"))).alias("__lines"),
        F.length(_without(text, _SPACES)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!?"))).cast("bigint").alias("n_marks"),
    )
    words = F.col("__words")
    n = F.size("__words")
    grams = F.when(
        n >= 5,
        F.transform(
            F.sequence(F.lit(0), n - 5),
            lambda i: F.xxhash64(*[_nth(words, i + k) for k in range(5)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__grams", grams)
    # most texts repeat nothing; the others sort their windows and look at neighbours
    some = F.size(F.array_distinct("__grams")) < F.size("__grams")
    ordered = F.when(
        some, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    )
    df = df.withColumn("__ordered", ordered)
    s = F.col("__ordered")
    again = F.filter(
        F.transform(
            s,
            lambda x, j: F.when(
                (x["g"] == F.coalesce(_nth(s, j - 1)["g"], F.bitwise_not(x["g"]))) | (x["g"] == F.coalesce(_nth(s, j + 1)["g"], F.bitwise_not(x["g"]))), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.sequence(i, i + 4)))))
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        n.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(s.isNotNull(), covered).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        "n_marks",
        (n - F.size(F.array_distinct("__words"))).cast("bigint").alias("n_not_distinct"),
    )


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1, to about 1e-11."""
    z = x + 7.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = F.lit(1.0)
    for i in range(7):
        product = product * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), by its terms from k downwards; 1 where k >= n * p.

    Terms beyond the first 20,000 are bounded by a geometric series, which adds to the
    value; below that the sum is exact to double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    term = F.exp(
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    steps = F.least(k, F.lit(20_000.0)).cast("int")
    # the ratio of each term to the one above it
    ratio = lambda i: (k - i + 1) * (1 - p) / ((n - k + i) * p)
    start = F.struct(term.alias("term"), term.alias("total"))
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["total"] + a["term"] * ratio(i)).alias("total")),
        lambda a: a["total"] + F.when(k > steps, a["term"] * ratio(steps + 1) / (1 - ratio(steps + 1))).otherwise(0.0),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(summed, F.lit(1.0)))


def certified(good: DataFrame, stratum_col: str, risk: Risk = Risk()) -> DataFrame:
    """Cutoffs per stratum: ``stratum`` and a column per rule, null where none is certified.

    ``good`` holds the counts of labelled good documents that the base rules keep.  Counts
    are summed up before the shuffle, so a stratum with most of the rows is no hot task.
    """
    cutoffs = sorted(risk.cutoffs, reverse=True)
    # how many cutoffs of the grid, lenient first, would reject the row
    def reach(rule: str) -> Column:
        count, base = RULES[rule]
        return sum((100 * F.col(count) >= c * F.col(base)).cast("int") for c in cutoffs)

    rows = good.select(
        F.col(stratum_col).alias("stratum"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), reach(r).alias("reach")) for r in RULES])).alias("x"),
    ).groupBy("stratum", "x.rule").agg(
        F.count(F.lit(1)).alias("n"),
        # cutoff number j (0 is the most lenient) rejects the rows that more than j cutoffs reach
        F.array(*[F.sum((F.col("x.reach") >= len(cutoffs) - j).cast("bigint")) for j in range(len(cutoffs))]).alias("wrong"),
    )
    strata = good.select(stratum_col).distinct().count()
    tried = rows.select("stratum", "rule", "n", F.posexplode("wrong").alias("j", "k"))
    tail = binomial_tail(F.col("k"), F.col("n"), risk.share / len(RULES))
    tried = tried.withColumn("sure", tail <= risk.error / len(RULES) / max(strata, 1))
    grid = F.array(*[F.lit(c) for c in cutoffs])
    failed = F.coalesce(F.min(F.when(~F.col("sure"), F.col("j"))), F.lit(len(cutoffs)))
    passed = tried.groupBy("stratum", "rule").agg(F.get(grid, failed - 1).alias("cutoff"))
    return passed.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    )


def judge(
    docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: Risk = Risk(), id_col: str = "doc_id"
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``; no text.

    ``labels`` (the id, ``quality`` 1: good) calibrate the cutoffs; other values, null ids
    and ids with both labels count as not good; repeated label rows count once, repeated
    documents each.  Null strata are a stratum.  Without labels ``kept`` is what the base
    rules keep.
    """
    rows = written(
        counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), "text")).withColumn(
            "base_failed", base_failed()
        )
    )
    fine = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        (F.min(F.coalesce(F.col("quality"), F.lit(0))) == 1).alias("good"), F.max("quality").alias("top")
    ).filter("good and top = 1 and doc_id is not null").select("doc_id")
    good = rows.filter("not base_failed").join(fine, "doc_id", "left_semi")
    # a row per stratum with enough labels, broadcast if that is small
    cuts = sized(written(certified(good, "stratum", risk)).withColumnRenamed("stratum", "__stratum"))
    judged = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for rule, (count, base) in RULES.items():
        rejected = rejected | F.coalesce(100 * F.col(count) >= F.col(f"cut_{rule}") * F.col(base), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", *[f"cut_{r}" for r in RULES])
