"""Byte-pair encoding with a public byte-level vocabulary, and decoding.

Texts are cut at single blanks into chunks, chunks into words by the vocabulary's
pattern, and every distinct word is merged once per worker and table: a contiguous array
holds one id per part and the rank of each adjacent pair; the smallest rank is looked for
by a scan, its boundary deleted and the two neighbouring ranks looked up again.  Words of
equal length take these steps together, as rows of one array.  For long words, where a
scan for each merge would be quadratic, the pairs wait in a heap; the merges are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

# The word pattern of byte-level vocabularies, white space spelled out; {letter} and {digit} are
# filled in by :func:`word_pattern`.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{{letter}}]+| ?[{{digit}}]+| ?[^{SPACE}{{letter}}{{digit}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# Neighbouring code points that the library is asked for in one text.
CODES_AT_ONCE = 256
# A word of more bytes than this is merged with a heap.
SHORT_BYTES = 128
# Entries of a worker's table of chunks; the table starts anew when it is full.
CACHE_ENTRIES = 400_000
# Characters of the texts that are encoded together.
CHARS_AT_ONCE = 1_000_000

_NO_RANK = 1 << 60
_TOUCHING = re.compile(r" \s|\s |\A | \Z")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes
    stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=1)
def word_pattern() -> regex.Pattern:
    """The word pattern with the letters and digits that the tokenizers library itself knows.

    Unicode tables differ between releases of libraries, so its pre-tokenizer is asked once per worker: neighbouring
    code points come back as runs of one kind, and a run's first one tells the kind by whether it goes on a word
    or a number.
    """
    pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    space = regex.compile(f"[{SPACE}]")
    kinds: dict[str, list[str]] = {"a": [], "1": []}
    for start in range(0, 0x110000, CODES_AT_ONCE):
        codes = [chr(c) for c in range(start, start + CODES_AT_ONCE) if not 0xD800 <= c < 0xE000]
        text = space.sub("\n", "".join(codes))
        for _, (at, end) in pieces(text):
            for before, own in kinds.items():
                if text[at] != "\n" and len(pieces(before + text[at])) == 1:
                    own.append(f"{regex.escape(text[at])}-{regex.escape(text[end - 1])}")
                    break
    return regex.compile(PATTERN.format(letter="".join(kinds["a"]), digit="".join(kinds["1"])))


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        # (left id, right id) -> order of the merge, and the id that it makes
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {vocab[a] << 32 | vocab[b]: n for n, (a, b) in enumerate(pairs)}
        self.pair_keys = np.array(sorted(self.rank), np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        size = max(vocab.values()) + 1
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * max(size, *[i + 1 for i in added.values()])
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.pattern = word_pattern()
        self.ascii_pattern = regex.compile(PATTERN.format(letter="A-Za-z", digit="0-9"))
        self.chunks: dict[str, bytes] = {"": b"", **self.added}
        self.words: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Order of the merge of each pair, or :data:`_NO_RANK`."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_RANK)

    def _merge_short(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge words of one length at once; ``parts`` has a row per word, a column per part.

        Every step deletes one boundary in each word that still has a ranked pair, so the
        rows stay of equal length; words without one leave.  Gives (row numbers, ids).
        """
        rows = np.arange(len(parts))
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            width = parts.shape[1]
            lowest = ranks.min(axis=1) if width > 1 else np.full(len(rows), _NO_RANK)
            done = lowest == _NO_RANK
            if done.any():
                yield rows[done], parts[done]
                go = ~done
                rows, parts, ranks, lowest = rows[go], parts[go], ranks[go], lowest[go]
                if not len(rows):
                    return
            i = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            parts[each, i] = self.made[lowest]
            keep = np.ones(parts.shape, bool)
            keep[each, i + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, i] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            for at, there in ((i, i < width - 2), (i - 1, i > 0)):
                r, c = each[there], at[there]
                ranks[r, c] = self._ranks(parts[r, c], parts[r, c + 1])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in O(n log n): pairs in a heap by rank and place, parts as a linked list."""
        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        rank = self.rank.get
        heap = [
            (r, i, parts[i], parts[i + 1])
            for i in range(n - 1)
            if (r := rank(parts[i] << 32 | parts[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue  # one of the two parts has been merged meanwhile
            parts[i] = int(self.made[r])
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := rank(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, there in zip(parts, alive) if there]

    def _merge_words(self, new: list[str]) -> None:
        """Add the ids of distinct words to the table of words."""
        raw = [w.encode() for w in new]
        by_length: dict[int, list[int]] = {}
        for n, word in enumerate(raw):
            by_length.setdefault(len(word), []).append(n)
        for length, own in by_length.items():
            if length > SHORT_BYTES:
                for n in own:
                    ids = self._merge_long([self.byte_id[b] for b in raw[n]])
                    self.words[new[n]] = np.array(ids, "<u4").tobytes()
                continue
            letters = np.frombuffer(b"".join([raw[n] for n in own]), np.uint8).reshape(len(own), length)
            for rows, parts in self._merge_short(self.byte_ids[letters]):
                step = 4 * parts.shape[1]
                ids = parts.astype("<u4").tobytes()
                for k, row in enumerate(rows.tolist()):
                    self.words[new[own[row]]] = ids[k * step : k * step + step]

    def _add_chunks(self, new: set[str]) -> None:
        words = {c: (self.ascii_pattern if c.isascii() else self.pattern).findall(c) for c in new}
        self._merge_words(list({w for c in words.values() for w in c if w not in self.words}))
        for chunk, parts in words.items():
            self.chunks[chunk] = b"".join([self.words[w] for w in parts])

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text without added tokens; added tokens as chunks of their own."""
        if self.special is not None and self.special.search(text):
            return [c for p in self.special.split(text) if p for c in ([p] if p in self.added else self._blanks(p))]
        return self._blanks(text)

    @staticmethod
    def _blanks(text: str) -> list[str]:
        # a blank between two characters that are no white space always begins a word
        parts = _SINGLE_BLANK.split(text) if _TOUCHING.search(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; added tokens become their ids.

        Call it with a few megabytes at a time: the tables of chunks and words start anew
        between calls when they are full.
        """
        if len(self.chunks) >= CACHE_ENTRIES or len(self.words) >= CACHE_ENTRIES:
            self.chunks = {"": b"", **self.added}
            self.words = {}
        cut = [self._cut(t) for t in texts]
        new: set[str] = set()
        for chunks in cut:
            new.update(chunks)
        new.difference_update(self.chunks)
        self._add_chunks(new)
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, tokens)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary, built once per worker."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; it goes to the workers with the task."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def in_slices(texts: list[str], chars: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, at least one text each."""
    own: list[str] = []
    held = 0
    for text in texts:
        own.append(text)
        held += len(text)
        if held >= chars:
            yield own
            own, held = [], 0
    if own:
        yield own


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, and ``ids`` (binary, little-endian unsigned 32-bit).

    A null text counts as empty, an empty text has no ids; ids are not looked at, so null or
    repeated ones stay as they are.  Other columns of ``df`` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [i for part in in_slices(texts) for i in own.encode_many(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: the id, and ``decoded``, the text of its ids (null: empty)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    rows = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; digests in place of ids and texts.

    Columns: the id, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` (lowercase hex).
    Nulls and empty texts as in :func:`encode`.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for part in in_slices([t or "" for t in batch.column(1).to_pylist()]):
                for ids in own.encode_many(part):
                    n.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
