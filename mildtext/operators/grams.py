"""Overlap of two texts of one row in n-grams: the base of BLEU, chrF and cosine.

Both texts are columns of one row, so their overlap needs no shuffle: it is added
as a few numbers per row, and a corpus score is one aggregation of those.  The
texts are brought into shape and their n-grams counted by a small vectorised function
over Arrow batches.  Counting with explode and groupBy gives
the same numbers, but makes twelve rows out of a character and moves the texts by
key; for chrF over the toxic documents it took about six times as long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.functions import shapes
from mildtext.functions.scores import cosine_from_sums
from mildtext.operators.once import once
from mildtext.session import small_batches

WORD_ORDER = 4  # fixed value: BLEU n-gram orders 1..4
CHAR_ORDER = 6  # fixed value: chrF n-gram orders 1..6
UNITS_AT_ONCE = 1_000_000  # words or characters counted together; bounds the memory of a worker
# Units looked ahead for where two texts meet again, units that must agree there, and places without such before giving up.
AHEAD, ANCHOR, MISSES = 64, 8, 64


def _fields(orders: int) -> list[str]:
    sides = [f"{side}_{n}" for n in range(1, orders + 1) for side in ("left", "right", "match")]
    return [*sides, "ab", "aa", "bb"]


def _common(left: str, right: str) -> list[tuple[int, int, int]]:
    """Places in both and lengths of equal stretches, in order; any such list will do, long stretches save work."""
    if left == right:
        return [(0, 0, len(left))] if left else []
    found, i, j, missed = [], 0, 0, 0
    while i < len(left) and j < len(right) and missed < MISSES:
        same, step = 0, AHEAD
        while step:
            part = left[i + same : i + same + step]
            if part and part == right[j + same : j + same + step]:
                same, step = same + len(part), step * 2
            else:
                step = min(step, len(left) - i - same, len(right) - j - same) // 2
        if same:
            found.append((i, j, same))
            i, j = i + same, j + same
        # either side has more here: where does the other go on?
        a = left.find(right[j : j + ANCHOR], i, i + AHEAD + ANCHOR) if j + ANCHOR <= len(right) else -1
        b = right.find(left[i : i + ANCHOR], j, j + AHEAD + ANCHOR) if i + ANCHOR <= len(left) else -1
        if a >= 0 and (b < 0 or a - i <= b - j):
            i = a
        elif b >= 0:
            j = b
        else:
            i, j, missed = i + 1, j + 1, missed + 1
    return found


def count_overlap(left: list[str], right: list[str], orders: int, chars: bool) -> pd.DataFrame:
    """Per pair of texts and order: n-grams on both sides and common ones, as multisets.

    ``ab``, ``aa`` and ``bb`` are the products of the counts of order one.  Words
    are separated by one blank.

    N-grams inside a stretch that both texts have are common ones, one for one; only those that
    reach out of the stretches are counted, since min(c + a, c + b) = c + min(a, b).  An n-gram is
    numbered by the number of its first n-1 units, which holds the row, and its last unit, so
    numbers are exact.
    """
    rows = len(left)
    if chars:
        texts = [*left, *right]
    else:
        # a word of both sides is one character
        same = [a == b for a, b in zip(left, right)]
        asked = [*left, *("" if s else b for s, b in zip(same, right))]
        lists = pc.split_pattern(pa.array(asked, pa.string()), " ")
        filled = np.fromiter(map(bool, asked), bool, 2 * rows)
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        codes = pc.list_flatten(lists).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        whole = codes[np.repeat(filled, n_words)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.where(filled, n_words, 0)).tolist()
        texts = [whole[a:b] for a, b in zip([0, *ends], ends)]
        texts[rows:] = [a if s else b for s, a, b in zip(same, texts, texts[rows:])]
    sizes = np.fromiter(map(len, texts), np.int64, 2 * rows)
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _products(units, sizes, rows)
    if orders == 1:
        return pd.DataFrame(out | {"left_1": sizes[:rows], "right_1": sizes[rows:]})[_fields(1)]
    starts = np.cumsum(sizes) - sizes
    places = [(row, i, j, n) for row in range(rows) for i, j, n in _common(texts[row], texts[rows + row])]
    block_row, block_i, block_j, length = np.array(places, np.int64).reshape(-1, 4).T

    def per_row(owner: np.ndarray, amount: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=amount, minlength=rows).astype(np.int64)

    # units from a place to the end of its stretch, 0 outside; then the places from which some order reaches out
    inside = np.zeros(len(units), np.int32)
    for first in (starts[block_row] + block_i, starts[rows + block_row] + block_j):
        for a, n in zip(first.tolist(), length.tolist()):
            inside[a : a + n] = np.arange(n, 0, -1, dtype=np.int32)
    at = np.flatnonzero(inside < orders)
    text = np.searchsorted(starts + sizes, at, side="right")
    row, is_left, to_end = text % max(rows, 1), text < rows, (starts + sizes)[text] - at
    inside, number = inside[at], row.copy()
    width = int(units.max(initial=0)) + 1
    for n in range(1, orders + 1):
        keep = to_end >= n
        at, row, is_left, to_end, inside, number = (x[keep] for x in (at, row, is_left, to_end, inside, number))
        number, grams = pd.factorize(number * width + units[at + n - 1])
        own = inside < n
        a = np.bincount(number[own & is_left], minlength=len(grams))
        b = np.bincount(number[own & ~is_left], minlength=len(grams))
        owner = np.zeros(len(grams), np.int64)
        owner[number] = row
        both = np.maximum(sizes - n + 1, 0)
        out[f"left_{n}"], out[f"right_{n}"] = both[:rows], both[rows:]
        out[f"match_{n}"] = per_row(owner, np.minimum(a, b)) + per_row(block_row, np.maximum(length - n + 1, 0))
    return pd.DataFrame(out)[_fields(orders)]


def _products(units: np.ndarray, sizes: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """Per row, out of the counts of single units on both sides: their products, and how many are common."""
    used = np.bincount(units) > 0
    n_used, code = int(used.sum()), (np.cumsum(used) - 1)[units]
    cell = np.repeat(np.tile(np.arange(rows), 2), sizes) * n_used + code
    if rows * n_used > 4 * len(units):
        cell, cells = pd.factorize(cell)
    else:
        cells = np.arange(rows * n_used)
    n_left = int(sizes[:rows].sum())
    a, b = (np.bincount(part, minlength=len(cells)) for part in (cell[:n_left], cell[n_left:]))
    owner, found = cells // max(n_used, 1), {"ab": a * b, "aa": a * a, "bb": b * b, "match_1": np.minimum(a, b)}
    return {name: np.bincount(owner, weights=x, minlength=rows).astype(np.int64) for name, x in found.items()}


def _counted(kind: str, left: list[str | None], right: list[str | None]) -> pd.DataFrame:
    """:func:`count_overlap` of both sides as ``kind`` counts them; null on the left stands for the text on the right.

    A text takes its shape once, and a pair is counted once: several rewrites of a text are often the same.
    """
    right = ["" if b is None else b for b in right]
    left = [b if a is None else a for a, b in zip(left, right)]
    texts = list(dict.fromkeys([*left, *right]))
    shaped = dict(zip(texts, SHAPES[kind](texts)))
    numbers: dict[tuple[str, str], int] = {}
    place = [numbers.setdefault((shaped[a], shaped[b]), len(numbers)) for a, b in zip(left, right)]
    found = count_overlap([a for a, _ in numbers], [b for _, b in numbers], ORDERS[kind], kind == "char")
    return found if len(numbers) == len(place) else found.take(place).reset_index(drop=True)


def _overlap_udf(kinds: dict[str, int], flagged: tuple[Callable, int] | None = None):
    """One function of pairs of columns, the first two being number 0; the fields of each kind, counted on the pair
    of its number, under its name.

    ``flagged`` adds the tokens on the right of a pair, and those that match; languages are the last column then.
    """

    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        flags = flagged and flagged[0]()
        for columns in batches:
            texts = [c.tolist() for c in columns]
            found = []
            for kind, at in kinds.items():
                left, right = texts[2 * at], texts[2 * at + 1]
                ends = np.cumsum([len(a or "") + len(b or "") for a, b in zip(left, right)]) // UNITS_AT_ONCE
                starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(left)]
                parts = [_counted(kind, left[i:j], right[i:j]) for i, j in zip(starts, starts[1:]) if j > i]
                whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_fields(ORDERS[kind]))
                found.append(whole.add_prefix(f"{kind}_"))
            if flagged:
                found.append(_flag_counts(flags, texts[2 * flagged[1] + 1], texts[-1]))
            yield pd.concat(found, axis=1)

    fields = [f"{k}_{f} bigint" for k in kinds for f in _fields(ORDERS[k])]
    return F.pandas_udf(count, ", ".join([*fields, *(["n_tokens int", "n_flagged int"] if flagged else [])]))


def _flag_counts(flags: Callable, lower: list[str | None], langs: list[str | None]) -> pd.DataFrame:
    """``n_tokens`` and ``n_flagged`` as of ``rewrite.count_flagged_inline``, null for no text."""
    known: dict[tuple[str, str | None], tuple[int, int]] = {}
    counts: list[tuple[int | None, int | None]] = []
    for text, lang in zip(lower, langs):
        if text is None:
            counts.append((None, None))
            continue
        # a text without tokens is one empty token; equal ones, as rewrites often are, are looked up once
        tokens = text.split()
        flat = " ".join(tokens)
        if (flat, lang) not in known:
            known[flat, lang] = len(tokens), sum(map(flags(lang).__getitem__, tokens or [""]))
        counts.append(known[flat, lang])
    sizes, hits = ([c[n] for c in counts] for n in (0, 1))
    return pd.DataFrame({"n_tokens": pd.array(sizes, "Int32"), "n_flagged": pd.array(hits, "Int32")})


ORDERS = {"word": WORD_ORDER, "char": CHAR_ORDER, "term": 1}
# How a text is counted; ``term`` gets it in lower case.
SHAPES = {"word": shapes.flat_13a, "char": shapes.without_space, "term": shapes.collapse}


def add_overlaps(df: DataFrame, flagged: tuple[Callable, str] | None = None, **kinds: tuple[str, str]) -> DataFrame:
    """Add a struct column per kind, ``word`` (BLEU), ``char`` (chrF) or ``term`` (cosine), of two columns
    each; all in one pass through Python, which takes texts that several kinds ask for once.

    ``flagged`` is what ``rewrite.flags_by_scope`` gave for one list, and the column of languages: ``n_tokens`` and
    ``n_flagged`` of the text on the right of ``term`` are added in that pass too.
    """
    own = ["n_tokens", "n_flagged"] if flagged else []
    columns = [c for c in df.columns if c not in kinds and c not in own]
    sides, numbers = {}, {}
    for kind, pair in kinds.items():
        lower = kind == "term"
        at = numbers.setdefault((*pair, lower), len(numbers))
        left, right = (F.col(c) for c in pair)
        ready = F.lower if lower else lambda c: c
        # null on the left: the same text as on the right
        sides[f"__left_{at}"] = F.when(~left.eqNullSafe(right), F.coalesce(ready(left), F.lit("")))
        sides[f"__right_{at}"] = ready(right)
    places = {kind: numbers[(*pair, kind == "term")] for kind, pair in kinds.items()}
    small_batches(df.sparkSession)
    ready = once(df, **sides)
    asked = [F.col(c) for c in sides]
    if flagged:
        udf = _overlap_udf(places, (flagged[0], numbers[(*kinds["term"], True)]))
        asked.append(F.col(f"`{flagged[1]}`"))
    else:
        udf = _overlap_udf(places)
    counted = ready.select(*[F.col(f"`{c}`") for c in columns], udf(*asked).alias("__found"))
    structs = [
        F.struct(*[F.col(f"__found.{kind}_{f}").alias(f) for f in _fields(ORDERS[kind])]).alias(kind) for kind in kinds
    ]
    return counted.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"__found.{c}") for c in own], *structs)


def add_overlap(df: DataFrame, kind: str, left: str, right: str) -> DataFrame:
    """:func:`add_overlaps` of one kind."""
    return add_overlaps(df, **{kind: (left, right)})


def term_cosine() -> Column:
    """Cosine of the word counts, out of the column ``term``; 0 if one text has no words."""
    return cosine_from_sums(*(F.col(f"term.{p}").cast("double") for p in ("ab", "aa", "bb")))


# --- corpus scores ----------------------------------------------------------


def corpus_sums(kind: str) -> list[Column]:
    """Aggregates over rows with the column ``kind``: sums per order and side.

    chrF leaves the n-grams of a rewrite out where its reference has none of that order.
    """
    orders = WORD_ORDER if kind == "word" else CHAR_ORDER
    sums = []
    for n in range(1, orders + 1):
        left, right, match = (F.col(f"{kind}.{side}_{n}") for side in ("left", "right", "match"))
        if kind == "char":
            left = F.when(right > 0, left).otherwise(0)
        for side, value in (("left", left), ("right", right), ("match", match)):
            sums.append(F.sum(value).cast("double").alias(f"{kind}_{n}_{side}"))
    return sums


def bleu() -> Column:
    """Corpus BLEU (0..100) out of :func:`corpus_sums`.

    Orders up to 4 that occur, clipped matches, exponential smoothing of orders
    without a match, brevity penalty; 0 if nothing matches at all.
    """
    log_sum, used, zeros = F.lit(0.0), F.lit(0), F.lit(0)
    reached = F.lit(True)
    for n in range(1, WORD_ORDER + 1):
        total, match = F.col(f"word_{n}_left"), F.col(f"word_{n}_match")
        reached = reached & (total > 0)
        zeros = zeros + F.when(reached & (match == 0), 1).otherwise(0)
        precision = F.when(match > 0, 100.0 * F.try_divide(match, total)).otherwise(
            F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), zeros) * total)
        )
        log_sum = log_sum + F.when(reached, F.ln(precision)).otherwise(0.0)
        used = used + F.when(reached, 1).otherwise(0)
    sys_len, ref_len = F.col("word_1_left"), F.col("word_1_right")
    any_match = sum((F.col(f"word_{n}_match") for n in range(2, WORD_ORDER + 1)), F.col("word_1_match"))
    penalty = F.when(sys_len < ref_len, F.exp(1.0 - F.try_divide(ref_len, sys_len))).otherwise(1.0)
    return F.when(any_match > 0, penalty * F.exp(F.try_divide(log_sum, used))).otherwise(0.0)


def chrf(beta: float = 2.0) -> Column:
    """Corpus chrF (0..100) out of :func:`corpus_sums`: mean precision and recall, then F."""
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHAR_ORDER + 1):
        left, right, match = (F.col(f"char_{n}_{s}") for s in ("left", "right", "match"))
        both = (left > 0) & (right > 0)
        precision = precision + F.when(both, F.try_divide(match, left)).otherwise(0.0)
        recall = recall + F.when(both, F.try_divide(match, right)).otherwise(0.0)
        used = used + F.when(both, 1).otherwise(0)
    p, r = F.try_divide(precision, used), F.try_divide(recall, used)
    weight = beta * beta
    score = 100.0 * F.try_divide((1.0 + weight) * p * r, weight * p + r)
    return F.coalesce(score, F.lit(0.0))


def corpus_bleu(df: DataFrame, by: list[str], prediction: str = "prediction",
                reference: str = "neutral") -> DataFrame:
    """BLEU per group."""
    rows = add_overlap(df, "word", prediction, reference)
    return rows.groupBy(*by).agg(*corpus_sums("word")).select(*by, bleu().alias("bleu"))


def corpus_chrf(df: DataFrame, by: list[str], prediction: str = "prediction",
                reference: str = "neutral") -> DataFrame:
    """chrF per group."""
    rows = add_overlap(df, "char", prediction, reference)
    return rows.groupBy(*by).agg(*corpus_sums("char")).select(*by, chrf().alias("chrf"))
