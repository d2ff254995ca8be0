"""Removal of word sequences that occur more than once in the corpus.

A window of ``words`` consecutive words has an anchor: the smallest digest among its short
sequences (``anchor`` words each).  Equal windows have equal anchors at equal places, so
only places with one anchor need to be compared.  A run of windows with one anchor is a passage.

1. Digests of anchors and passages of all documents are counted.  A passage that occurs
   twice is repeated as a whole; one whose anchor occurs nowhere else is not at all.
2. What is left are passages that share an anchor but differ somewhere: the ends of copied
   text, and edited copies.  One copy of each distinct passage goes, by its anchor, to a
   reference shard of bounded size.
3. Each shard builds the suffix automaton of its passages, counts how often each state
   occurs, and streams the passages through it.  The matching statistics, over states that
   occur at least twice, give the maximal repeated spans; those of ``words`` words or more
   are removed.

Shards hold the words themselves.  No window lies inside a passage of another anchor, so a
shard never meets one occurrence twice, and no shard has to see another's passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.llm import wordhash
from mildtext.llm.common import lean, sliced, written
from mildtext.session import small_batches


@dataclass(frozen=True)
class Spans:
    """``words`` of a window and of its ``anchor``; an anchor with more than ``passages`` distinct
    passages is cut into single windows, so that no shard grows with the corpus; ``shard``
    words are enough for one automaton."""

    words: int = 35
    anchor: int = 8
    passages: int = 1_000
    shard: int = 20_000


class Passages:
    """Runs of windows with one anchor, in some texts."""

    def __init__(self, texts: list[bytes], how: Spans) -> None:
        self.words = words = wordhash.Words(texts)
        starts = words.windows(how.words)
        grams = len(words.start) - how.anchor + 1
        if len(starts):
            at = np.arange(grams)
            digests = words.digest(at, at + how.anchor - 1)
            # the leftmost smallest digest of each window
            views = np.lib.stride_tricks.sliding_window_view(digests, how.words - how.anchor + 1)
            place = (views.argmin(axis=1) + np.arange(len(views)))[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
        else:
            digests = np.zeros(0, np.uint64)
            place = first = last = np.zeros(0, np.int64)
        #: first word of the first and of the last window of each passage
        self.first, self.last = starts[first], starts[last]
        self.text = words.text[self.first]
        self.anchor = digests[place[first]]
        self.digest = words.digest(self.first, self.last + how.words - 1)
        #: passages of text i: from bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))


class Automaton:
    """Suffix automaton of some word sequences, with the weighted number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        following, link, length, count = self.next, self.link, self.length, self.count
        for word in sequence:
            found = following[last].get(word)
            if found is not None and length[found] == length[last] + 1:
                last = found
                count[last] += weight
                continue
            state = len(following)
            if found is None:
                following.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(weight)
            at = last
            while at != -1 and word not in following[at]:
                following[at][word] = state
                at = link[at]
            if at == -1:
                last = state
                continue
            other = following[at][word]
            if length[other] == length[at] + 1:
                link[state] = other
                last = state
                continue
            clone = len(following)
            following.append(dict(following[other]))
            length.append(length[at] + 1)
            link.append(link[other])
            count.append(0)
            link[other] = clone
            if found is None:
                link[state] = clone
                last = state
            else:  # the sequence ends in the clone itself
                count[clone] += weight
                last = clone
            while at != -1 and following[at].get(word) == other:
                following[at][word] = clone
                at = link[at]

    def close(self) -> None:
        """Carry the numbers of occurrences to all suffixes; nothing can be added afterwards."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def statistics(self, sequence: list) -> Iterator[int]:
        """For each place, how many words up to it occur at least twice in what was added."""
        following, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        for word in sequence:
            while True:
                found = following[state].get(word)
                if found is not None and count[found] >= 2:
                    state, matched = found, matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            yield matched


def _digests(words: wordhash.Words) -> np.ndarray:
    """One digest for all words of each text; 0 for none."""
    out = np.zeros(words.n_texts, np.uint64)
    some = np.flatnonzero(words.count)
    out[some] = words.digest(words.first[some], words.first[some] + words.count[some] - 1)
    return out


def _described(docs: DataFrame, how: Spans) -> DataFrame:
    """``id``, ``digest`` of all words, and anchors and digests of the passages of every row."""
    kind = docs.schema["id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digest, anchors, passages, n = [], [], [], []
            for _, texts in wordhash.in_slices([wordhash.normal(t) for t in batch.column(1).to_pylist()]):
                found = Passages(texts, how)
                digest.append(_digests(found.words))
                anchors.append(found.anchor)
                passages.append(found.digest)
                n.append(np.diff(found.bounds))
            if not n:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(anchors).view(np.int64))),
                # the whole digest: one anchor can have millions of passages, and nothing compares their words afterwards
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(passages).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(digest).view(np.int64)), *lists], ["id", "digest", "a", "c"]
            )

    rows = docs.mapInArrow(run, f"id {kind}, digest bigint, a array<bigint>, c array<bigint>")
    return rows.withColumn("row", F.monotonically_increasing_id())


# What a passage is: it occurs twice and all of its anchor's do the same; it is one of several
# of its anchor and occurs once; or it is one of several and occurs twice.
REPEATED, OPEN, BOTH = 1, 2, 3


def _states(described: DataFrame, how: Spans) -> DataFrame:
    """``a``, ``c``, ``state`` and ``heavy`` of the distinct passages whose anchor occurs at least twice."""

    def summed(a: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, a))
        a, c, n = a[order], c[order], n[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        return a[at], c[at], np.add.reduceat(n, at) if len(at) else n

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # copies in a batch become one row before the shuffle
            a, c = (batch.column(k).flatten().to_numpy() for k in ("a", "c"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(a, c, np.ones(len(a), np.int64))], ["a", "c", "n"])

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in ("a", "c", "n")))
            size += batch.num_rows
            if size > 2_000_000 and len(held) > 1:  # equal rows of many batches
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                size = 0
        if not held:
            return
        a, c, n = summed(*(np.concatenate(x) for x in zip(*held)))
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(new)
        kinds = np.diff(np.append(at, len(a)))
        total = np.repeat(np.add.reduceat(n, at) if len(at) else n, kinds)
        kinds = np.repeat(kinds, kinds)
        state = np.where(kinds == 1, REPEATED, np.where(n == 1, OPEN, BOTH)).astype(np.int32)
        keep = total >= 2
        columns = [a[keep], c[keep], state[keep], kinds[keep] > how.passages]
        for start in range(0, int(keep.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[start : start + 100_000]) for x in columns], ["a", "c", "state", "heavy"])

    counted = described.select("a", "c").mapInArrow(count, "a bigint, c bigint, n bigint")
    return counted.repartition("a").mapInArrow(decide, "a bigint, c bigint, state int, heavy boolean")


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text squeezed (``z``) and the digest of its words: a text that goes through a shuffle should be small."""
    fields = docs.schema.fields
    at = docs.columns.index(text_col)
    names = [f"c{n}" for n in range(len(fields)) if n != at]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            digests = [_digests(wordhash.Words(part)) for _, part in wordhash.in_slices([wordhash.normal(t) for t in texts])]
            digest = np.concatenate(digests) if digests else np.zeros(0, np.uint64)
            z = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in texts]
            others = [batch.column(n) for n in range(len(fields)) if n != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(digest.view(np.int64)), pa.array(z, pa.binary())], [*names, "digest", "z"])

    shape = ", ".join(f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(fields) if n != at)
    return docs.mapInArrow(run, shape + ", digest bigint, z binary")


def _open(z: bytes | None) -> str | None:
    return None if z is None else zstandard.decompress(z).decode("utf-8", "surrogatepass")


def _passages(texts: DataFrame, how: Spans) -> DataFrame:
    """The passages of ``texts`` (``row``, ``z``, ``own``: place, state and weight of passages) that are to be compared.

    ``shard``; ``row`` and ``first``, the place of the first word, null for passages that are
    but references; ``weight``; ``words``, joined by blanks.
    """
    names = ["shard", "row", "first", "weight", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # references that this task has sent
        for batch in sliced(batches):
            rows, owns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            normals = [wordhash.normal(_open(z)) for z in batch.column(1).to_pylist()]
            for start, part in wordhash.in_slices(normals):
                out: list[tuple] = []
                found = Passages(part, how)
                words, first, last = found.words, found.first.tolist(), found.last.tolist()
                lefts, rights, raw = words.start, words.end, b"\n".join(part)
                for i in range(len(part)):
                    base, zero = int(found.bounds[i]), int(words.first[i])
                    for own in owns[start + i]:
                        k = base + own["k"]
                        if own["heavy"]:  # each window by itself
                            cuts = [(w, w + how.words - 1) for w in range(first[k], last[k] + 1)]
                            shards = words.digest(np.arange(first[k], last[k] + 1), np.arange(first[k], last[k] + 1) + how.words - 1)
                        else:
                            cuts, shards = [(first[k], last[k] + how.words - 1)], found.anchor[k : k + 1]
                        both = own["state"] == BOTH
                        for (a, b), shard in zip(cuts, shards.view(np.int64).tolist()):
                            if both:
                                name = int(found.digest[k]) if not own["heavy"] else shard
                                if name in given:
                                    continue
                                given.add(name)
                            out.append((shard, None if both else rows[start + i], None if both else a - zero, 2 if both else 1, raw[lefts[a] : rights[b]].decode("utf-8", "surrogatepass")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return texts.select("row", "z", "own").mapInArrow(run, "shard bigint, row bigint, first bigint, weight int, words string")


def _matched(passages: DataFrame, how: Spans) -> DataFrame:
    """``row``, ``first``, ``last``: spans of at least ``words`` words that occur twice in their shard."""

    def spans(members: list[tuple]) -> Iterator[tuple[int, int, int]]:
        automaton = Automaton()
        cut = [m[4].split(" ") for m in members]
        for member, sequence in zip(members, cut):
            automaton.add(sequence, member[3])
        automaton.close()
        for (_, row, first, _, _), sequence in zip(members, cut):
            if row is None:
                continue
            begin = end = None
            for at, matched in enumerate(automaton.statistics(sequence)):
                if matched < how.words:
                    continue
                if end is not None and at - matched + 1 <= end + 1:
                    end = at  # the same span goes on
                    continue
                if end is not None:
                    yield row, first + begin, first + end
                begin, end = at - matched + 1, at
            if end is not None:
                yield row, first + begin, first + end

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, shard = 0, None
        for batch in batches:
            out: list[tuple] = []
            for member in zip(*[c.to_pylist() for c in batch.columns]):
                if member[0] != shard and size >= how.shard:
                    out += spans(held)
                    held, size = [], 0
                shard = member[0]
                held.append(member)
                size += member[4].count(" ") + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "first", "last"])
        out = list(spans(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "first", "last"])

    ordered = passages.repartition("shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(run, "row bigint, first bigint, last bigint")


def remove(docs: DataFrame, how: Spans = Spans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated spans: the same rows and columns, the text's kept words joined by one blank,
    and ``n_words`` and ``n_removed`` (long).

    Every word covered by a window of ``words`` words that starts anywhere else too, in the
    same text or row included, goes; windows are judged on the input.  A text that loses nothing stays
    as it is, one that loses all becomes empty, a null text stays null.  Null and repeated
    ids are kept; equal rows are occurrences each, so both lose what they share.  Columns
    of ``docs`` named ``n_words`` or ``n_removed`` are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed")])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = written(_described(rows, how))
    states = written(_states(described, how))
    each = described.select("row", F.posexplode(F.arrays_zip("a", "c")).alias("k", "x")).select("row", "k", "x.a", "x.c")
    marks = each.join(states, ["a", "c"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("k", "state", "heavy"))).alias("own")  # the passages of one text
    )
    # equal texts under one id have equal marks
    marks = written(described.select("row", "id", "digest").join(marks, "row").dropDuplicates(["id", "digest"]))
    compared = marks.select("id", "digest", "row", F.filter("own", lambda x: x["state"] != REPEATED).alias("own")).filter(F.size("own") > 0)
    texts = _packed(rows, "text").withColumnRenamed("c0", "id")

    def joined(left: DataFrame, key: str, right: DataFrame, kind: str) -> DataFrame:
        right = right.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), *[c for c in right.columns if c not in ("id", "digest")])
        return left.join(right, F.col(key).eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), kind)

    spans = _matched(_passages(joined(texts, "id", compared, "inner"), how), how)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    repeated = F.transform(F.filter("own", lambda x: x["state"] != OPEN), lambda x: x["k"])
    marks = marks.select("id", "digest", "row", repeated.alias("repeated")).join(spans, "row", "left").drop("row")
    marks = written(marks)

    kept = [f for f in docs.schema.fields if f.name != text_col]
    at = {f.name: n for n, f in enumerate(docs.schema.fields)}
    columns = [f"c{at[f.name]}" for f in kept]
    whole = joined(_packed(docs, text_col), f"c{at[id_col]}", marks, "left").select(*columns, "z", "repeated", "spans")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [_open(z) for z in batch.column("z").to_pylist()]
            repeated_all, spans_all = batch.column("repeated").to_pylist(), batch.column("spans").to_pylist()
            n_words, n_removed, out = [], [], []
            for start, part in wordhash.in_slices([wordhash.normal(t) for t in texts]):
                found = Passages(part, how)
                words = found.words
                change = np.zeros(len(words.start) + 1, np.int64)
                for i in range(len(part)):
                    own = np.array(repeated_all[start + i] or [], np.int64) + found.bounds[i]
                    np.add.at(change, found.first[own], 1)
                    np.add.at(change, found.last[own] + how.words, -1)
                    for span in spans_all[start + i] or ():
                        change[words.first[i] + span["first"]] += 1
                        change[words.first[i] + span["last"] + 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                lost = np.bincount(words.text[gone], minlength=len(part))
                n_words += words.count.tolist()
                n_removed += lost.tolist()
                for i, text in enumerate(part):
                    if not lost[i]:
                        out.append(texts[start + i])
                        continue
                    own = gone[words.first[i] : words.first[i] + words.count[i]].tolist()
                    out.append(b" ".join([w for w, g in zip(text.split(b" "), own) if not g]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*columns, "text", "n_words", "n_removed"],
            )

    shape = "".join(f"{c} {f.dataType.simpleString()}, " for c, f in zip(columns, kept)) + "text string, n_words bigint, n_removed bigint"
    done = whole.mapInArrow(cut, shape)
    named = {f.name: F.col(c).alias(f.name) for c, f in zip(columns, kept)} | {text_col: F.col("text").alias(text_col)}
    return done.select(*[named[c] for c in docs.columns], "n_words", "n_removed")
