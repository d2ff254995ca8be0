"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. The documents are written once where they lie, as chunks: what one task read is a chunk,
   with its normal texts, their SHA-256 and a fingerprint.  Chunks are bucketed, so later steps
   read a chunk in one task without a shuffle.
2. A chunk sorts its distinct fingerprints and sends every owner, which is a range of
   fingerprints, the gaps between those of its range, Golomb-coded: about eleven bits each,
   however often a text occurs in the chunk.
3. An owner decodes and merges what it got and answers every chunk with a bitmap: one bit for
   each fingerprint that another chunk sent too.
4. Only suspects, documents whose bit is set or whose fingerprint the chunk itself holds
   twice, leave their chunk; they are grouped by the bytes of their normal texts.

Fingerprints are only as long as they must be to let one in a thousand documents be a suspect
for nothing; the bytes decide.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.session import SHARED_BYTES, materialize, measured_bytes, scratch, shared

# Bits of a fingerprint beyond those that number the documents: 2 ** -10 suspects for nothing.
SPARE_BITS = 10
# Fingerprints of one owner, on average.
OWNED = 1 << 20


def normal_text(text: Column) -> Column:
    """Every run of blank, tab, \\n, \\v, \\f, \\r as one blank; null as empty."""
    # lone blanks are no match, so that most texts stay as they are
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}", " ")


# --- Golomb code with a power of two as its parameter

def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending distinct numbers as (bits of a remainder, unary quotients, remainders) of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1.0, float(values[-1]) / len(values))
    k = max(0, int(math.log2(mean * math.log(2)))) if mean > 1.5 else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    places = np.arange(k, dtype=np.uint64)
    rest = (gaps[:, None] >> places & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The ``n`` numbers of :func:`encode`."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    remainders = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(k)) | remainders)


# --- the exchange

class Exchange:
    """Fingerprints of ``bits`` bits, in ranges of ``owners`` owners."""

    def __init__(self, documents: int, least_owners: int) -> None:
        self.bits = min(62, max(1, documents).bit_length() + SPARE_BITS)
        self.owners = max(least_owners, -(-documents // OWNED))
        # values from bounds[i] to below bounds[i + 1] are those of owner i
        self.bounds = np.array([(i << self.bits) // self.owners for i in range(self.owners + 1)], np.uint64)

    def sorted(self, chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values of a chunk, the value of each row, rows of each value, and where owners begin."""
        digest = chunk.column("fingerprint").to_numpy().view(np.uint64)
        values, of, rows = np.unique(digest >> np.uint64(64 - self.bits), return_inverse=True, return_counts=True)
        return values, of, rows, np.searchsorted(values, self.bounds)

    def send(self, chunk: pa.Table) -> pa.Table:
        values, _, _, at = self.sorted(chunk)
        out = []
        for owner in np.flatnonzero(np.diff(at)).tolist():
            own = values[at[owner] : at[owner + 1]] - self.bounds[owner]
            out.append((chunk.column("chunk")[0].as_py(), owner, len(own), *encode(own)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MESSAGES)], schema=_MESSAGES)

    def answer(self, messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        sent = [decode(m["n"], m["k"], m["unary"], m["rest"]) for m in rows]
        _, of, senders = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        twice, at, bitmaps = senders[of] > 1, 0, []
        for values in sent:
            bitmaps.append(np.packbits(twice[at : at + len(values)]).tobytes())
            at += len(values)
        return pa.table([messages.column("chunk").combine_chunks(), messages.column("owner").combine_chunks(), pa.array(bitmaps, pa.binary())], schema=_ANSWERS)

    def receive(self, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Numbers of the rows of a chunk that are suspect, as 64 bits in each number of a list."""
        values, of, rows, at = self.sorted(chunk)
        twice = rows > 1
        for owner, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()):
            own = slice(at[owner], at[owner + 1])
            twice[own] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: own.stop - own.start].astype(bool)
        place = chunk.column("place").to_numpy()
        bits = np.zeros(-(-(int(place.max()) + 1) // 64) * 64, np.uint8)
        bits[place[twice[of]]] = 1
        suspects = np.packbits(bits, bitorder="little").view(np.int64)
        return pa.Table.from_arrays(
            [pa.array([chunk.column("chunk")[0].as_py()], pa.int32()), pa.array([suspects.tolist()], pa.list_(pa.int64()))], schema=_SUSPECTS
        )


_MESSAGES = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("bitmap", pa.binary())])
_SUSPECTS = pa.schema([("chunk", pa.int32()), ("suspects", pa.list_(pa.int64()))])


def _held(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents in chunks, bucketed: ``chunk``, ``place`` in it, ``id``, ``text``, ``sha``, ``fingerprint``."""
    spark = docs.sparkSession
    # computed once, behind a generator of one row, and not again for each column that needs the text
    texts = docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(normal_text(F.col(text_col)).alias("text")))))
    number = F.monotonically_increasing_id()
    rows = texts.select(
        F.shiftrightunsigned(number, 33).cast("int").alias("chunk"),
        number.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("place"),
        "id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("fingerprint"),
    )
    name = f"mildtext_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.bucketBy(buckets, "chunk").option("path", f"{scratch(spark)}/{name}").option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def _suspects(held: DataFrame) -> DataFrame:
    """``chunk`` and ``suspects``: a bit for every place of the chunk."""
    documents = held.count()
    way = Exchange(documents, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = held.select("chunk", "place", "fingerprint").groupBy("chunk")
    messages = chunks.applyInArrow(lambda chunk: way.send(chunk), "chunk int, owner int, n int, k int, unary binary, rest binary")
    answers = messages.groupBy("owner").applyInArrow(lambda messages: way.answer(messages), "chunk int, owner int, bitmap binary")
    received = chunks.cogroup(answers.groupBy("chunk"))
    return received.applyInArrow(lambda chunk, answers: way.receive(chunk, answers), "chunk int, suspects array<bigint>")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are the same bytes after every run of white space (blank, tab, \\n,
    \\v, \\f, \\r) became one blank; null is empty.  Of equal texts the row with the smallest id
    stays.  Ids that repeat are rows of their own: one of the rows with the smallest id stays.
    A null id is larger than any other.  Other columns are left out, whatever their names.
    Empty table: no rows.
    """
    held = _held(docs, id_col, text_col)
    bits = materialize(_suspects(held))
    bits = F.broadcast(bits) if measured_bytes(bits) <= SHARED_BYTES else bits.hint("shuffle_hash")
    word = F.element_at("suspects", F.shiftright("place", 6) + 1)
    marked = held.join(bits, "chunk").withColumn("suspect", F.getbit(word, F.col("place") % 64) == 1)
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "chunk", "place")
    same = (
        marked.filter("suspect")
        .groupBy("sha", "text")
        .agg(F.min(row).alias("keep"), F.count(F.lit(1)).alias("size"))
        # bytes have decided; different texts of one digest would be told apart here, not merged
        .groupBy("sha")
        .agg(F.min("keep").alias("keep"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts of one SHA-256")).cast("bigint")).otherwise(F.col("size")))
        .filter("size > 1")
        .drop("texts")
    )
    narrow = marked.select("chunk", "place", "id", "sha", "suspect")
    alone = narrow.filter("not suspect").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    several = F.col("keep").isNotNull()
    met = narrow.filter("suspect").join(shared(same), "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(several, F.col("keep.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (~several | ((F.col("keep.chunk") == F.col("chunk")) & (F.col("keep.place") == F.col("place")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(met)
