"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents (pieces of at most ``capacity`` tokens) and gaps of open sequences are sorted by
length.  Lengths are integers up to the capacity, so the sorted order is a run per length,
and documents of one run are interchangeable: what tells them apart is their rank in it,
which Spark computes without gathering a run anywhere.  One superstep per run, longest
first: a successor sweep over the gap runs matches all documents of the run to the
tightest gaps that hold them, ranks resolve who gets which gap, the gaps shrink, and the
next run follows.  The steps see counts only, at most ``capacity`` of them whatever the size of the corpus, and
come out as intervals of ranks; each document then finds its own interval in parallel.
This is exactly best-fit decreasing.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mildtext.llm.bpe import byte_letters, in_slices
from mildtext.llm.common import lean, words, written

# Entries of a worker's table of words; when it is full, words that do not come again go.
CACHE_ENTRIES = 350_000
# Ranks in a run are below 2 to this power.
_RANK_BITS = 43
# The cut into words of the vocabulary file with word ends.
_LETTERS_APART = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Latin letters and at most one sign.  Not İ, and no other scripts: there small or composed
# letters may depend on their neighbours.
_SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,;:!?]?)")


class _Known(dict):
    """Word to ids; a new word is looked up among the words that were known before, then encoded.

    Tables of two generations: words that come again move on to the next one, and most
    words never do.
    """

    def __init__(self, encode, before: dict[str, bytes]) -> None:
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found


class WordIds:
    """Ids of texts by the tokenizers library, which is asked once per distinct word.

    Right for vocabularies that drop white space and look at no more than one word at a
    time; a special token inside a word is left to the library.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known = _Known(self._encode, {})
        # letters and a sign behind them are words of their own, and capitals become small ones, if the file says so
        self.plain = json.loads(vocabulary)["pre_tokenizer"] == _LETTERS_APART and self._whole("Ab.") == self._whole("ab.")
        self.signs = {sign: self._whole(sign) for sign in ".,;:!?"} | {"": b""}
        self.byte_letter = {byte: letter for letter, byte in byte_letters().items()}

    def _whole(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def _encode(self, word: str) -> bytes:
        """Ids of one word: if it is of letters, straight from the library's model."""
        m = _SIMPLE.fullmatch(word) if self.plain else None
        if m is None:
            return self._whole(word)
        letters, sign = m.groups()
        letters = letters.lower()
        if not letters.isascii():  # the model sees a letter for each byte
            letters = "".join([self.byte_letter[b] for b in letters.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes() + self.signs[sign]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) >= CACHE_ENTRIES:
            self.known.before = {}
            self.known = _Known(self._encode, self.known)
        known = self.known.__getitem__
        return [b"".join(map(known, words(t))) for t in texts]


_LOADED: dict[int, WordIds] = {}


def _word_ids(vocabulary: str) -> WordIds:
    key = zlib.crc32(vocabulary.encode())
    if key not in _LOADED:
        _LOADED[key] = WordIds(vocabulary)
    return _LOADED[key]


def pieces(
    df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Documents as token pieces: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, and
    ``shard`` and ``place``, which number the pieces of a length within a task.

    A document is the ids of its text and ``end_id``; a null or empty text has ``end_id``
    alone.  Only documents above ``capacity`` are cut.  With ``keep_ids`` the ids of a
    piece (binary, little-endian unsigned 32-bit) are a column too.  Null or repeated ids
    are kept; every row is a document of its own.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32", "shard", "place"] + ["ids"] * keep_ids
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _word_ids(vocabulary)
        shard = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = 0
            for part in in_slices(texts):
                for ids in own.encode_many(part):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at : at + step]
                        length = len(cut) // 4
                        row = (n, k, at // 4, length, zlib.crc32(cut), shard, seen[length])
                        rows.append((*row, cut) if keep_ids else row)
                        seen[length] += 1
                    n += 1
            columns = list(zip(*rows)) or [()] * len(names)
            taken = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, *[pa.array(c, t) for c, t in zip(columns[1:], types[1:])]], names
            )

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, place bigint"
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = rows.mapInArrow(run, schema + ", ids binary" * keep_ids)
    return out.withColumnRenamed("id", id_col)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps of best-fit decreasing over runs of equal length.

    Gives (length, first rank, first sequence, pieces per sequence, offset in the sequence, sequences): the
    documents of that length from that rank on go, ``pieces per sequence`` at a time, into
    consecutive sequences.  A step ends a run of documents or a run of gaps, and a gap that
    has taken all it can is less than half as long, so there are at most about
    ``2 * capacity * log2(capacity)`` steps, however many documents.
    """
    steps = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    present: list[int] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(present, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(present, length)  # the successor: the tightest gap that is long enough
            if at < len(present):
                gap = present[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del present[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            fits = gap // length
            full = min(n, left // fits)
            if full:
                steps.append((length, rank, first, fits, capacity - gap, full))
                rank += full * fits
                left -= full * fits
                add(gap - fits * length, first, full)
            if full < n and left:  # fewer than fill one more gap
                steps.append((length, rank, first + full, left, capacity - gap, 1))
                add(gap - left * length, first + full, 1)
                add(gap, first + full + 1, n - full - 1)
                left = 0
            else:
                add(gap, first + full, n - full)
    return steps


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of :func:`pieces`; drops ``shard``, ``place``.

    The pieces are written first: tokenising is not repeated, and the ranks stay the same
    when executors are lost.  Sequences are gapless from offset 0 and hold at most
    ``capacity`` tokens; equal lengths are told apart by task and place.  No rows: no rows.
    """
    cut = written(cut)
    runs = cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    counts = dict(cut.groupBy("length").count().collect())  # at most `capacity` rows
    steps = np.array(sorted(best_fit(counts, capacity)) or np.zeros((0, 6)), np.int64)
    keys = (steps[:, 0] << _RANK_BITS) + steps[:, 1]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = steps[np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1]
            k = rank - own[:, 1]
            found = [own[:, 2] + k // own[:, 3], own[:, 4] + k % own[:, 3] * length]
            names = [f.name for f in batch.schema if f.name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(x) for x in found]], [*names, "sequence_id", "offset"]
            )

    kept = [c for c in cut.columns if c not in ("shard", "place")]
    ranked = cut.join(runs, ["length", "shard"]).select(*kept, (F.col("before") + F.col("place")).alias("rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: ``sequence_id``, ``length`` and ``ids`` (binary); the pieces need their ids.

    A group is one sequence, so it is bounded by the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
