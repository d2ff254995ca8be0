"""Score expressions: label maps, cosine, distance, fluency, success predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names in order of precedence; "True" means 1 - score.
LABEL_PRECEDENCE = (
    ("toxic", False),
    ("neutral", True),
    ("non_toxic", True),
    ("label_1", False),
    ("label_0", False),
)
UNKNOWN_LABEL_SCORE = 0.5


def label_map_toxicity(label_map: Column) -> Column:
    """Toxicity out of a label -> score map; names compare without case.

    ``label_0`` alone counts as the toxicity, although by convention it is the
    neutral class: kept as it is, since only such maps reach that branch.
    """
    entries = F.map_entries(label_map)
    choices = []
    for name, complement in LABEL_PRECEDENCE:
        matching = F.filter(entries, _named(name))
        score = F.try_element_at(matching, F.lit(-1))["value"]
        choices.append(1.0 - score if complement else score)
    return F.coalesce(*choices, F.lit(UNKNOWN_LABEL_SCORE))


def _named(name: str):
    return lambda entry: F.lower(entry["key"]) == name


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0.0 if either has no length."""
    return cosine_from_sums(dot(a, b), dot(a, a), dot(b, b))


def cosine_from_sums(ab: Column, aa: Column, bb: Column) -> Column:
    norm = F.sqrt(aa) * F.sqrt(bb)
    return F.when(norm > 0, ab / norm).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def normalized_fluency(ppl: Column, base_ppl: float = 1000.0) -> Column:
    """max(0, 1 - ln(ppl) / ln(base)); null for a missing or non-positive perplexity."""
    return F.when(
        ppl > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.ln(ppl) / F.lit(math.log(base_ppl)))
    )


def success(tox: Column, threshold: float = 0.5) -> Column:
    """1.0 if the toxicity is strictly below the threshold, else 0.0."""
    return (tox < threshold).cast("double")


def similar(sim: Column, threshold: float = 0.75) -> Column:
    return sim > threshold
