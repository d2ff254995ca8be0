"""Periodic runs in the words of a text: stretches that repeat with a period.

A run is a maximal stretch with smallest period q and at least max(``least``, 2q) words.  It holds
two words i and i + p with i on the grid of multiples of p that are equal, so for every period p
the pairs (0, p), (p, 2p), ... of a text are tried: n/1 + n/2 + ... pairs, in NumPy.

1. A few words around a pair are compared.  Nearly all pairs, and all texts without runs, end here.
2. What is left asks how far both places of a pair agree, to the right and to the left.  The
   words at a place are compared only until both places come to sampled ones, which is within 31
   words: the residues of a difference cover modulo 31 are sampled.  From there the answer is the
   least common prefix between the two sampled suffixes in sorted order, out of a sparse table.
   Only sampled suffixes are sorted, about one in five.
3. Pairs that agree over enough words are runs; one found by several pairs, or by multiples of its
   period, is one run with the smallest.

A text is one row of its task and is not split; memory is a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.llm.common import sliced, words

# A perfect difference cover, every difference modulo 31 is one of two of these.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

# Words of the texts that are worked on together, and pairs that are held at once.
TOGETHER = 100_000
PAIRS = 500_000


def _shifts() -> np.ndarray:
    """For places a and b modulo 31, how many words on both are sampled."""
    table = np.empty((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            table[a, b] = next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
    return table


SHIFTS = _shifts()


class CommonExtension:
    """How many words from two places on are equal, for many pairs of places.

    ``ids`` are numbers from 0 on; texts are told apart by numbers that occur once.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        # beyond the end every place has a word of its own: no suffix goes on there
        self.ids = np.concatenate([ids, np.arange(2 * MODULUS) + (int(ids.max()) + 1 if len(ids) else 0)])
        residue = np.zeros(MODULUS, bool)
        residue[list(COVER)] = True
        self.places = np.flatnonzero(residue[np.arange(self.n) % MODULUS])
        self._sort()

    def _sort(self) -> None:
        places, m = self.places, len(self.places)
        of = np.full(self.n + 1, -1)
        of[places] = np.arange(m)
        # names of the 31 words at each sampled place, in their order
        blocks = np.lib.stride_tricks.sliding_window_view(self.ids.astype(">u4"), MODULUS)[places]
        order = np.argsort(np.ascontiguousarray(blocks).view(f"V{4 * MODULUS}").ravel().view(f"S{4 * MODULUS}"), kind="stable") if m else np.zeros(0, int)
        ranks = [_names(order, (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1))]
        # twice as many words by each round; the place 31 words on is sampled too
        length = MODULUS
        while m and ranks[-1].max() < m - 1:
            after = np.minimum(places + length, self.n)
            later = np.where(after < self.n, ranks[-1][of[after]], -1 - np.arange(m))
            order = np.lexsort((later, ranks[-1]))
            first, then = ranks[-1][order], later[order]
            ranks.append(_names(order, (first[1:] != first[:-1]) | (then[1:] != then[:-1])))
            length *= 2
        self.rank = np.zeros(self.n, np.int64)
        self.rank[places] = ranks[-1]
        self._table(order, ranks, of)

    def _table(self, order: np.ndarray, ranks: list[np.ndarray], of: np.ndarray) -> None:
        """Common prefixes of neighbours in sorted order, and their least over 2, 4, 8, ... neighbours."""
        a, b = self.places[order[:-1]], self.places[order[1:]]
        common = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            inside = np.flatnonzero((x < self.n) & (y < self.n))
            x, y = of[x[inside]], of[y[inside]]
            common[inside[ranks[level][x] == ranks[level][y]]] += MODULUS << level
        self.least = [self._compare(a, b, common, np.full(len(a), MODULUS))]
        width = 1
        while 2 * width <= len(a):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compare(self, a: np.ndarray, b: np.ndarray, common: np.ndarray, most: np.ndarray) -> np.ndarray:
        """``common`` and up to ``most`` more words from there on, compared one by one."""
        common = common.copy()
        going, step = np.arange(len(a)), 0
        while len(going):
            going = going[most[going] > step]
            x, y = a[going] + common[going], b[going] + common[going]
            there = (x < self.n) & (y < self.n)
            going, x, y = going[there], x[there], y[there]
            going = going[self.ids[x] == self.ids[y]]
            common[going] += 1
            step += 1
        return common

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on; the places of a pair differ, and may be the end."""
        shift = SHIFTS[a % MODULUS, b % MODULUS]
        common = self._compare(a, b, np.zeros(len(a), np.int64), shift)
        on = np.flatnonzero((common == shift) & (a + shift < self.n) & (b + shift < self.n))
        x, y = self.rank[a[on] + shift[on]], self.rank[b[on] + shift[on]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        for k in range(int(level.max()) + 1 if len(on) else 0):
            at = np.flatnonzero(level == k)
            common[on[at]] += np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return common


def _names(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from 0 on of what is sorted by ``order``; ``new``: differs from the one before."""
    names = np.zeros(len(order), np.int64)
    names[order[1:]] = np.cumsum(new)
    return names


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, p) with i a multiple of p, i + p < n and 2p <= n, some periods at a time."""
    first = 1
    while first <= n // 2:
        last = min(n // 2, first + max(0, PAIRS * first // n))
        periods = np.arange(first, last + 1)
        counts = (n - 1) // periods
        p = np.repeat(periods, counts)
        begin = np.cumsum(counts) - counts
        yield (np.arange(len(p)) - np.repeat(begin, counts)) * p, p
        first = last + 1


def _likely(ids: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, p) around which a few words agree: as many as each run has at one of its pairs."""
    n = len(ids)
    # a run has max(least, 2p) words, so at least this many neighbours agree with the word p further on
    few = max(1, (least + 1) // 2)
    for i, p in _grid(n):
        same = np.flatnonzero(ids[i] == ids[i + p])
        i, p = i[same], p[same]
        got, right = np.ones(len(i), np.int64), np.arange(len(i))
        for step in range(1, few):
            right = right[i[right] + p[right] + step < n]
            right = right[ids[i[right] + step] == ids[i[right] + p[right] + step]]
            got[right] += 1
        left = np.flatnonzero(got < few)
        for step in range(1, few):
            left = left[i[left] >= step]
            left = left[ids[i[left] - step] == ids[i[left] + p[left] - step]]
            got[left] += 1
        enough = got >= few
        if enough.any():
            yield i[enough], p[enough]


class _Texts:
    """Texts with likely pairs, one behind the other, and how far their pairs agree."""

    def __init__(self, texts: list[np.ndarray], least: int) -> None:
        self.texts, self.least = texts, least
        self.begins = np.concatenate([[0], np.cumsum([len(ids) + 1 for ids in texts])])
        top = max(int(ids.max()) for ids in texts) + 1
        # a word of its own behind each text
        joined = np.concatenate([part for k, ids in enumerate(texts) for part in (ids, [top + k])])
        self.last = len(joined) - 1
        self.right, self.left = CommonExtension(joined), CommonExtension(joined[::-1].copy())

    def stretches(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distinct (start, length, period) of the stretches around pairs that are long enough."""
        end = i + p + self.right(i, i + p)
        # in the reversed order: the words before both places
        start = i - self.left(self.last - (i + p) + 1, self.last - i + 1)
        long = end - start >= np.maximum(self.least, 2 * p)
        return np.unique(np.stack([start[long], (end - start)[long], p[long]], axis=1), axis=0)

    def runs(self) -> list[np.ndarray]:
        found, held, size = [], [], 0
        for begin, ids in zip(self.begins, self.texts):
            for i, p in _likely(ids, self.least):
                held.append((i + begin, p))
                size += len(i)
                if size >= PAIRS:
                    found.append(self.stretches(*map(np.concatenate, zip(*held))))
                    held, size = [], 0
        if held:
            found.append(self.stretches(*map(np.concatenate, zip(*held))))
        rows = np.unique(np.concatenate(found), axis=0)
        first = np.ones(len(rows), bool)  # equal stretches: the smallest period comes first
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[first]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        bounds = np.searchsorted(rows[:, 0], self.begins)
        return [rows[a:b] - [begin, 0, 0] for a, b, begin in zip(bounds[:-1], bounds[1:], self.begins)]


def find_runs(texts: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Per text, an array with a row (start, length, period) per run, by start and period.

    ``texts`` are arrays of word numbers from 0 on, equal for equal words.
    """
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    likely = [t for t, ids in enumerate(texts) if next(_likely(ids, least), None) is not None]
    if likely:
        for t, runs in zip(likely, _Texts([texts[t] for t in likely], least).runs()):
            out[t] = runs
    return out


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) > 0


def _numbered(texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
    known: dict[str, int] = {}
    cut = [words(t or "") for t in texts]
    return cut, [np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in cut]


def _together(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about :data:`TOGETHER` words, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // (6 * TOGETHER)
    for first, last in _stretches(part):
        yield batch.slice(first, last - first)


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length, period by start, then period) and ``text``,
    the words, joined by one blank, that are in no run behind its first period.

    Words are runs of anything but blank, tab, \\n, \\v, \\f, \\r, numbered from 0.  A null, empty or
    blank text has no words: no runs and an empty text.  Runs may overlap; of a stretch the
    smallest period is given, so there are no ties.  Repeated rows are judged each for itself, other
    columns are left out whatever their names, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for part in _together(batch, 1):
                cut, numbers = _numbered(part.column(1).to_pylist())
                found = find_runs(numbers, least)
                kept = []
                for ws, runs in zip(cut, found):
                    gone = dropped(len(ws), runs) if len(runs) else ()
                    kept.append(" ".join([w for w, g in zip(ws, gone) if not g] if len(runs) else ws))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
                flat = np.concatenate(found)
                values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(ws) for ws in cut], pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(kept, pa.string())],
                    ["id", "n_words", "runs", "text"],
                )

    out = rows.mapInArrow(judge, f"id {kind}, n_words bigint, runs array<{RUN}>, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def digests(collapsed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the longest run and SHA-256 digests of what :func:`collapse` gives; a projection."""
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = collapsed.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        id_col,
        F.size(runs).cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("collapsed_sha256"),
    )


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a period put into one in ten, by the CRC-32 of the id: ``id_col``, ``text_col``.

    Of a chosen text with n words, h the digest and g = h div 10, every word i from a = g mod n on
    becomes the word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8).  A null id has no
    digest and is not chosen; a text without words stays.
    """
    digest = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.coalesce(digest % 10 == 0, F.lit(False))
    # lists of words are made for chosen texts only
    words_of = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    ws, n, g = F.col("ws"), F.nullif(F.size("ws"), F.lit(0)), F.floor(digest / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    ready = docs.select(id_col, text_col, F.inline(F.array(F.struct(F.when(chosen, words_of).alias("ws")))))
    ready = ready.select(id_col, text_col, F.inline(F.array(F.struct(ws.alias("ws"), a.alias("a"), p.alias("p")))))
    repeated = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.element_at(
        "ws", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1))
    return ready.select(id_col, F.when(F.size("ws") > 0, F.array_join(repeated, " ")).otherwise(F.col(text_col)).alias(text_col))
