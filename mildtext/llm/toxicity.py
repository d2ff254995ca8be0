"""Toxicity by a weighted lexicon that is learned from labels.

Texts are folded (look-alike letters, digits for letters), cut into words and run
through an Aho-Corasick automaton of terms: whole words and beginnings of words.  A word
counts with its heaviest term, unless an exception phrase covers it.  Weights are smoothed
log odds of labelled documents; a logistic curve over the sum of weights, normalised by
length, turns them into a score.  Terms come from one part of the training rows, exceptions
and the curve from another, so the curve sees terms as new texts would show them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.llm.common import lean, sliced
from mildtext.session import small_batches

# Greek, Cyrillic and other letters that look like the Latin letter below them.
_ALIKE = str.maketrans({
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ı": "i", "ł": "l", "ø": "o",
    "đ": "d", "ɑ": "a", "ɡ": "g",
})
# Latin letters with marks -> the letter below, one character for one.
_PLAIN = {
    c: base for c in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFD", chr(c))[0]) and "a" <= base <= "z"
}
# Digits and signs that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_STANDS_IN = re.compile(r"(?<=[a-z])[0134578]|[0134578@$](?=[a-z])|(?<=[a-z])[@$!|](?=[a-z])")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Training:
    """Parameters of the training.

    ``rows`` bounds the labelled documents of each label that the model is fitted on, taken
    by a digest of the id; all rows are scored.  All terms and phrases of theirs that pass the
    other limits are in the model.
    """

    rows: int = 15_000
    min_documents: int = 4
    min_weight: float = 1.5
    min_z: float = 3.0
    threshold: float = 0.7


def fold(text: str) -> str:
    """Lower-case words between single blanks, with a blank at both ends.

    Compatibility forms and look-alikes of other scripts become Latin letters; a digit or
    sign next to letters becomes the letter that it stands for.  Accents stay: they tell
    words apart in many languages, see :meth:`Model.hits`.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_ALIKE)
    text = _STANDS_IN.sub(lambda m: _DIGITS[m[0]], text)
    return " " + _NO_LETTERS.sub(" ", text).strip() + " "


def terms_of(folded: str) -> set[str]:
    """Terms that the words of a text can match: `` word `` and `` begin`` (no blank behind)."""
    out = set()
    for word in set(folded.split()):
        if len(word) > 2:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in _BEGINNINGS if n <= len(word))
    return out


@dataclass
class Model:
    """Weights of terms, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-2.0, 0.0, 0.0, 0.0, 0.0])

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # built again in each worker

    def _built(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and self.weights:
            self._automaton = ahocorasick.Automaton()
            for phrase in self.phrases:
                self._automaton.add_word(phrase, (len(phrase), None))
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (len(term), weight))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each word that matches a term outside an exception -> its heaviest weight.

        A second pass without accents looks for whole words only.
        """
        automaton = self._built()
        if automaton is None:
            return {}
        found: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end + 1 - length
            if weight is None:
                excepted.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not folded.isascii():
            for end, (length, weight) in automaton.iter(folded.translate(_PLAIN)):
                start = end + 1 - length
                if weight is not None and folded[end] == " " and weight > found.get(start, 0.0):
                    found[start] = weight
        # phrases begin and end with a blank, so a word lies wholly in them or not at all
        for start, end in excepted:
            at = folded.find(" ", start)
            while at != -1 and at < end:
                found.pop(at, None)
                at = folded.find(" ", at + 1)
        return found

    def features(self, folded: str) -> tuple[float, ...]:
        """Weight by length, weight, hits and length of a text."""
        found = self.hits(folded).values()
        n, total = folded.count(" "), sum(found)
        return 10.0 * total / (n + 10.0), math.log1p(total), math.log1p(len(found)), math.log1p(n)

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a null or empty text has the score of a text without terms and words."""
        x = self.curve[0] + sum(w * f for w, f in zip(self.curve[1:], self.features(fold(text or ""))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: :func:`remainder` 1.  False for a null id."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def _counted(rows: DataFrame, keys_of, parts: str) -> DataFrame:
    """Documents per key and label: ``key``, ``toxic``, ``other``; counted in each task before the shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in sliced(batches):
            for toxic, text in zip(*[batch.column(c).to_pylist() for c in ("toxic", "text")]):
                counts[toxic].update(keys_of(fold(text or "")))
        keys = list(counts[0] | counts[1])
        for at in range(0, len(keys), 50_000):
            own = keys[at : at + 50_000]
            columns = [pa.array([counts[k][key] for key in own], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *columns], ["key", "toxic", "other"])

    each = rows.filter(parts).mapInArrow(run, "key string, toxic bigint, other bigint")
    return each.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a small ridge, by Newton's method; few columns, bounded rows."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)]) * max(1, len(y))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> Model:
    """Learn from ``labels`` (``doc_id``, ``toxic`` 0 or 1) of ids that are not held out.

    Labels other than 0 and 1 and null ids are left out; an id with both labels counts as
    toxic; repeated rows and texts count once.  Without labels
    of both kinds the score is the same small number for every text.
    """
    small_batches(docs.sparkSession)
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("id")) != 1))
    own = own.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit("training"))
    chosen = None
    for label in (0, 1):  # each a top-k of ids, so at most 2 * rows ids are shared with the tasks
        part = own.filter(F.col("toxic") == label).orderBy(order, "id").limit(settings.rows)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    # a text counts once, as toxic if any of its rows is, in the part of its smallest id
    rows = texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"))
    rows = rows.select("toxic", "text", (remainder(F.col("id")) == 0).alias("first"))
    rows = rows.persist()  # a bounded sample; lost blocks are read again
    try:
        sizes = {(r["first"], r["toxic"]): r["count"] for r in rows.groupBy("first", "toxic").count().collect()}
        n_toxic, n_other = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
        model = Model()
        if not (n_toxic and n_other):
            return model

        # every term that toxic documents have clearly more often than others; `rows` bounds them
        toxic, other = F.col("toxic"), F.col("other")
        expected = (toxic + other) * n_toxic / (n_toxic + n_other)
        z = (toxic - expected) / F.sqrt(F.greatest(expected, F.lit(0.25)))
        weight = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))
        telling = _counted(rows, terms_of, "first").filter(
            (toxic >= settings.min_documents) & (weight >= settings.min_weight) & (z >= settings.min_z)
        )
        model.weights = {r["key"]: r["weight"] for r in telling.select("key", weight.alias("weight")).collect()}

        def phrases_of(folded: str) -> Iterable[str]:
            out = set()
            for start in model.hits(folded):
                end = folded.find(" ", start + 1)
                before, after = folded.rfind(" ", 0, max(start, 0)), folded.find(" ", end + 1)
                if before != -1:
                    out.add(folded[before : end + 1])
                if after != -1:
                    out.add(folded[start : after + 1])
            return out

        # two words that hold a term but are seen in enough other documents, and no toxic one
        spoken = _counted(rows, phrases_of, "not first").filter(
            (F.col("toxic") == 0) & (F.col("other") >= settings.min_documents)
        )
        model = Model(model.weights, sorted(r["key"] for r in spoken.select("key").collect()))

        names = ["density", "weight", "hits", "words"]

        @lean
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = [model.features(fold(t or "")) for t in batch.column("text").to_pylist()]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), *[pa.array(c, pa.float64()) for c in columns]], ["toxic", *names]
                )

        shape = "toxic int, " + ", ".join(f"{n} double" for n in names)
        points = rows.filter("not first").select("toxic", "text").mapInArrow(measure, shape).collect()  # bounded by `rows`
        y = np.array([r["toxic"] for r in points], float)
        if 0 < y.sum() < len(y):
            x = np.array([[r[n] for n in names] for r in points])
            order_of = np.lexsort([*x.T, y])  # sums in one order, whatever the tasks' order
            model.curve = _curve(x[order_of], y[order_of])
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, settings: Training = Training(), text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``score`` and ``predicted`` (1 from the threshold on).

    One projection over whole texts; null and empty texts have a score too.  Columns of
    ``docs`` named ``score`` or ``predicted`` are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "score", "predicted")]
    names = [f"c{n}" for n in range(len(kept))]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [model.score(t) for t in batch.column(len(kept)).to_pylist()]
            flags = [int(s >= settings.threshold) for s in scores]
            columns = [*batch.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array(flags, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names)], F.col(f"`{text_col}`").alias("text"))
    shape = ", ".join([*[f"{n} {f.dataType.simpleString()}" for f, n in zip(kept, names)], "score double", "predicted int"])
    return rows.mapInArrow(run, shape).select(
        *[F.col(n).alias(f.name) for f, n in zip(kept, names)], "score", "predicted"
    )


def without_toxic(docs: DataFrame, model: Model, settings: Training = Training(), text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` below the threshold, all columns as they are; null and empty texts stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [model.score(t) < settings.threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
