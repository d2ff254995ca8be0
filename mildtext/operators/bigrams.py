"""Totals of word pairs over a corpus, brought to texts that ask for them.

Texts are cut into chunks of one language.  A chunk numbers its words and is written as numbers:
the digest of each word and the words of each text.  A pair of neighbouring words, and the first
word of a pair, its context, have 64-bit keys out of those digests.  A chunk sends its different
keys, sorted and cut into :data:`RANGES` ranges; whoever holds a range adds up what the corpus sent
and answers the chunks that ask, in the order of their keys.  So a key crosses once per chunk,
however frequent it is, and no word does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.functions import shapes
from mildtext.session import materialize, shared, small_batches

START = "<s>"
CHUNK_BYTES = 16 << 20  # different texts whose words are numbered together; bounds the memory of a worker
CHUNK_ROWS = 1 << 16  # texts of a chunk, whose keys are one row: bounds that row where texts are short
RANGE_BITS = 11
RANGES = 1 << RANGE_BITS
CORPUS, ASKED, BOTH, WORDS = 0, 1, 2, 3  # what a block of keys is for
PAIR, CONTEXT, WORD = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- numbers as bytes -------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Murmur3's last step: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _small(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each as narrow as the largest allows; the width comes first."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the leading ones are zeros, which the shuffle squeezes."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _squeezed(numbers: np.ndarray) -> bytes:
    raw = _small(numbers)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(raw: bytes) -> np.ndarray:
    return _numbers(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True))


# --- chunks -----------------------------------------------------------------


def chunks(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """``chunk, lang``, the ``keys`` of its texts as arrays, and as bytes the digests of its words, the words and
    the size of each different text, and which of those each text is; a missing language is ``""``."""
    texts = df.select(
        *[F.col(f"`{k}`").alias(f"key{n}") for n, k in enumerate(keys)],
        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("flat"),
    )
    texts = texts.withColumn("flat", F.lower("flat"))
    names = [f"key{n}" for n in range(len(keys))]
    kinds = dict(texts.dtypes)
    shape = ["chunk bigint", "lang string", *[f"{k} array<{kinds[k]}>" for k in names], "words binary", "ids binary", "sizes binary", "texts binary"]

    def cut(rows: pa.Table, number: int) -> pa.RecordBatch:
        different = rows.column("flat").combine_chunks().dictionary_encode()
        flat = different.dictionary
        lists = pc.split_pattern(flat, " ")
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        sizes = np.where(filled, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
        coded = pc.list_flatten(lists).dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        if not filled.all():  # a blank text has been cut into one empty word
            empty = words.index("")
            ids = ids[ids != empty]
            ids -= ids > empty
            del words[empty]
        words = np.array([*words, START], dtype=object)  # the start mark is the last word
        digests = pd.util.hash_array(words, categorize=False).astype("<u8")
        out = [pa.array([number], pa.int64()), rows.column("lang").combine_chunks().slice(0, 1)]
        for k in names:
            own = rows.column(k).combine_chunks()
            out.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        out += [pa.array([digests.tobytes()], pa.binary()), pa.array([_squeezed(ids)], pa.binary()), pa.array([_squeezed(sizes)], pa.binary())]
        out.append(pa.array([_squeezed(different.indices.to_numpy())], pa.binary()))
        return pa.RecordBatch.from_arrays(out, ["chunk", "lang", *names, "words", "ids", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, seen, size, rows = [], set(), 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            whole = pa.Table.from_batches(held)
            langs = whole.column("lang").combine_chunks()
            for lang in pc.unique(langs).to_pylist():
                yield cut(whole.filter(pc.equal(langs, lang)), number)
                number += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            at, start = batch.schema.get_field_index("flat"), 0
            flat = shapes.collapse(batch.column(at).to_pylist())
            batch = batch.set_column(at, "flat", pa.array(flat, pa.string()))
            lengths = pc.binary_length(batch.column("flat")).to_pylist()
            for row, text in enumerate(flat, 1):
                rows += 1
                if text not in seen:
                    seen.add(text)
                    size += lengths[row - 1]
                if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    held.append(batch.slice(start, row - start))
                    yield from flush()
                    start, held, seen, size, rows = row, [], set(), 0, 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from flush()

    return texts.mapInArrow(run, ", ".join(shape))


class _Chunk:
    """The pairs of a chunk, by key: what it sends, and where the answers go."""

    def __init__(self, lang: str, words: bytes, ids: bytes, sizes: bytes, texts: bytes):
        digests = np.frombuffer(words, "<u8").astype(np.uint64)
        own = pd.util.hash_array(np.array([lang], dtype=object), categorize=False).astype(np.uint64)
        first, last = _mixed(digests ^ _mixed(own + PAIR)), digests
        second, self.sizes, self.texts = _unsqueezed(ids), _unsqueezed(sizes), _unsqueezed(texts)
        start = len(digests) - 1
        before = np.empty_like(second)
        before[1:] = second[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = start
        # numbered by their first place: a hash table, where sorting would take several times as long
        self.pair_of, pairs = pd.factorize(before * (start + 1) + second)
        times = np.repeat(np.bincount(self.texts, minlength=len(self.sizes)), self.sizes)
        n_pairs = np.bincount(self.pair_of, weights=times, minlength=len(pairs)).astype(np.int64)
        w1, w2 = pairs // (start + 1), pairs % (start + 1)
        self.context_of = w1
        n_contexts = np.bincount(w1, weights=n_pairs, minlength=start + 1).astype(np.int64)
        context_keys = _mixed(digests ^ _mixed(own + CONTEXT))
        keys = np.concatenate([_mixed(first[w1] * PAIR + last[w2]), context_keys])
        # different pairs have different keys, but for collisions, which add up
        self.keys, self.place = np.unique(keys, return_inverse=True)
        amounts = np.concatenate([n_pairs, n_contexts])
        self.amounts = np.bincount(self.place, weights=amounts, minlength=len(self.keys)).astype(np.int64)
        seen = np.flatnonzero(np.bincount(second, minlength=start + 1))
        self.words = np.unique(_mixed(digests[seen] ^ _mixed(own + WORD)))

    def blocks(self, keys: np.ndarray, amounts: np.ndarray | None) -> Iterator[tuple[int, bytes, bytes | None]]:
        """Range, keys and amounts, for ranges with keys."""
        ends = np.searchsorted(keys >> np.uint64(64 - RANGE_BITS), np.arange(RANGES + 1, dtype=np.uint64)).tolist()
        for at in range(RANGES):
            a, b = ends[at], ends[at + 1]
            if b > a:
                yield at, _steps(keys[a:b]), None if amounts is None else _small(amounts[a:b])


def _blocks(rows: DataFrame, role: int) -> DataFrame:
    """``at, role, chunk, lang, block, amounts``: the keys of chunks by range, and their different words."""
    names = ["at", "role", "chunk", "lang", "block", "amounts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, lang, *raw = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                chunk = _Chunk(lang, *raw)
                sent = [(role, x) for x in chunk.blocks(chunk.keys, None if role == ASKED else chunk.amounts)]
                if role != ASKED:
                    sent += [(WORDS, x) for x in chunk.blocks(chunk.words, None)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for _, x in sent], pa.int32()), pa.array([r for r, _ in sent], pa.int32()),
                        pa.array([number] * len(sent), pa.int64()), pa.array([lang] * len(sent), pa.string()),
                        pa.array([x[1] for _, x in sent], pa.binary()), pa.array([x[2] for _, x in sent], pa.binary()),
                    ],
                    names,
                )

    own = rows.select("chunk", "lang", "words", "ids", "sizes", "texts")
    return own.mapInArrow(run, "at int, role int, chunk bigint, lang string, block binary, amounts binary")


def _answers(blocks: DataFrame) -> DataFrame:
    """``chunk, at, totals`` for every block that asks; for languages, ``lang, n_words``, the different words of a range."""
    names = ["chunk", "at", "totals", "lang", "n_words"]

    def answered(at: int, held: list[dict]) -> pa.RecordBatch:
        known = [r for r in held if r["role"] in (CORPUS, BOTH)]
        keys = np.concatenate([np.zeros(0, np.uint64), *[_keys(r["block"]) for r in known]])
        amounts = np.concatenate([np.zeros(0, np.int64), *[_numbers(r["amounts"]) for r in known]])
        order = np.argsort(keys, kind="stable")
        keys, amounts = keys[order], np.cumsum(amounts[order])
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
        keys, sums = keys[last], np.diff(amounts[last], prepend=0)
        out = []
        for r in held:
            if r["role"] in (ASKED, BOTH):
                own = _keys(r["block"])
                totals = np.zeros(len(own), np.int64)
                if len(keys):
                    spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    totals = np.where(keys[spot] == own, sums[spot], 0)
                out.append((r["chunk"], at, _small(totals), None, None))
        words: dict[str, list[np.ndarray]] = {}
        for r in held:
            if r["role"] == WORDS:
                words.setdefault(r["lang"], []).append(_keys(r["block"]))
        out += [(None, at, None, lang, len(np.unique(np.concatenate(own)))) for lang, own in words.items()]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["at"] != at and held:
                    yield answered(at, held)
                    held = []
                at = row["at"]
                held.append(row)
        if held:
            yield answered(at, held)

    ordered = blocks.repartition("at").sortWithinPartitions("at")
    return ordered.mapInArrow(run, "chunk bigint, at int, totals binary, lang string, n_words bigint")


def log_sums(
    asked: DataFrame, corpus: DataFrame, keys: list[str], text: str, lang: str, corpus_text: str, corpus_lang: str,
    k: float, same_corpus: bool,
) -> DataFrame:
    """``keys``, ``n`` words and ``ln_sum``, the sum of ln p over them with add-k counts, per text; a null sum
    where the corpus has no text of that language.

    With ``same_corpus`` the texts that ask are the corpus, and are read once.
    """
    small_batches(asked.sparkSession)
    own = materialize(chunks(asked, keys, text, lang))
    blocks = _blocks(own, BOTH if same_corpus else ASKED)
    if not same_corpus:
        blocks = blocks.unionByName(_blocks(chunks(corpus, [], corpus_text, corpus_lang), CORPUS))
    answers = materialize(_answers(blocks))
    sizes = answers.filter(F.col("n_words").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("v"))
    rows = own.join(shared(sizes), "lang", "left").withColumn("at", F.lit(-1))
    back = answers.filter(F.col("totals").isNotNull()).select("chunk", "at", "totals")
    names = [f"key{n}" for n in range(len(keys))]
    met = rows.unionByName(back, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "at")
    kinds = dict(asked.select(*[F.col(f"`{c}`") for c in keys]).dtypes)
    shape = [*[f"{name} {kinds[c]}" for name, c in zip(names, keys)], "n bigint", "ln_sum double"]

    def scored(head: pa.RecordBatch, totals: list[bytes]) -> pa.RecordBatch:
        chunk = _Chunk(*(head.column(c)[0].as_py() for c in ("lang", "words", "ids", "sizes", "texts")))
        v = head.column("v")[0].as_py()
        found = [head.column(name).flatten() for name in names]
        if v is None:
            sums = pa.nulls(len(chunk.texts), pa.float64())
        else:
            counts = np.concatenate([np.zeros(0, np.int64), *map(_numbers, totals)])[chunk.place]
            n_pairs = len(chunk.context_of)
            c12, c1 = counts[:n_pairs], counts[n_pairs:][chunk.context_of]
            ln_p = np.log((c12 + k) / (c1 + k * v))[chunk.pair_of]
            owner = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            sums = pa.array(np.bincount(owner, weights=ln_p, minlength=len(chunk.sizes))[chunk.texts], pa.float64())
        return pa.RecordBatch.from_arrays([*found, pa.array(chunk.sizes[chunk.texts], pa.int64()), sums], [*names, "n", "ln_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, totals = None, []
        for batch in batches:
            marks, places = batch.column("totals"), batch.column("at").to_pylist()
            for row, at in enumerate(places):
                if at < 0:
                    if head is not None:
                        yield scored(head, totals)
                    head, totals = batch.slice(row, 1), []
                else:
                    totals.append(marks[row].as_py())
        if head is not None:
            yield scored(head, totals)

    return met.mapInArrow(run, ", ".join(shape)).withColumnsRenamed(dict(zip(names, keys)))
