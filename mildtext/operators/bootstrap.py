"""Bootstrap confidence intervals of means, for any number of rows.

Drawing n rows with replacement, B times, gives each row a multinomial count.

Groups of at most :data:`DRAWN` rows are drawn just so: the rows of such a group come together, and
every draw is a row number out of a digest of (seed, group, draw).

In larger groups, independent Poisson(1) counts take the place of multinomial ones; they are its
limit for large n and need no knowledge of other rows.  Each row gets its count for each replicate
out of a digest of (seed, row key, replicate), and the replicate mean is the weighted mean.  Rows
add to B sums per group inside each task, so the shuffle carries at most B rows per group and task.
For a handful of rows these intervals are too wide: :func:`replicate_means` alone should not be
used there.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.session import materialize, shared

REPLICATES_PER_DIGEST = 4  # 16 bytes of a digest, 4 for each
ROWS_AT_ONCE = 2_000  # rows whose draws are held together
DRAWN = 100  # rows up to which a group is drawn exactly
GROUPS_AT_ONCE = 500  # groups whose sums a task holds


def poisson_bounds() -> list[str]:
    """Cumulative Poisson(1) probabilities as 8 hex digits: count k lies below bound k."""
    bounds, cumulative, k = [], 0.0, 0
    while True:
        cumulative += math.exp(-1.0) / math.factorial(k)
        scaled = round(cumulative * 2**32)
        if scaled >= 2**32:
            return bounds
        bounds.append(f"{scaled:08x}")
        k += 1


# Of MD5 (RFC 1321): the amounts of a round's turns, the additive constants, the word that each step takes.
_TURNS = [turn for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in turns * 4]
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TAKEN = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_STATE = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
ONE_BLOCK = 55  # bytes of the longest message of one block
DIGESTS_AT_ONCE = 1 << 14


def _digests(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """MD5 of every start with every end, 16 bytes each, by rows: one step for all, for messages of one block and one
    length of the starts."""
    size = len(starts[0])
    heads = np.frombuffer(b"".join(s.ljust(64, b"\0") for s in starts), "<u4").reshape(-1, 16, 1)
    tails = np.frombuffer(
        b"".join((bytes(size) + e + b"\x80").ljust(56, b"\0") + (8 * (size + len(e))).to_bytes(8, "little") for e in ends), "<u4"
    ).reshape(-1, 16)
    # a word that only starts or only ends have stays a column or a row
    words = []
    for n in range(16):
        head, tail = heads[:, n].astype(np.uint32), tails[:, n].astype(np.uint32)
        words.append(head if 4 * n + 4 <= size else tail[None, :] if 4 * n >= size else head | tail[None, :])
    a, b, c, d = (np.full((len(starts), len(ends)), x, np.uint32) for x in _STATE)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_TAKEN[i]] + _ADDED[i]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    found = np.stack([x + y for x, y in zip((a, b, c, d), _STATE)], axis=-1).astype("<u4")
    return found.view(np.uint8).reshape(len(starts), -1)


def _long_digests(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The same for messages of any length, one by one."""
    raw = bytearray()
    for s in starts:
        start = hashlib.md5(s)
        for end in ends:
            own = start.copy()
            own.update(end)
            raw += own.digest()
    return np.frombuffer(bytes(raw), np.uint8).reshape(len(starts), -1)


def draws(keys: list[str], n: int, seed: int) -> np.ndarray:
    """Poisson(1) counts: a row per key, a column per replicate."""
    blocks = math.ceil(n / REPLICATES_PER_DIGEST)
    ends = [f"|{block}".encode() for block in range(blocks)]
    starts = [f"{seed}|{key}".encode() for key in keys]
    bounds = np.array([int(b, 16) for b in poisson_bounds()], np.uint32)
    sizes = np.fromiter(map(len, starts), np.int64, len(starts))
    at_once = max(1, DIGESTS_AT_ONCE // max(1, blocks))
    found = np.empty((len(keys), n), np.float64)
    for size in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == size)
        digests = _digests if blocks and size + len(ends[-1]) <= ONE_BLOCK else _long_digests
        for at in range(0, len(same), at_once):
            part = same[at : at + at_once]
            raw = digests([starts[i] for i in part.tolist()], ends)
            found[part] = np.searchsorted(bounds, raw.view(">u4").astype(np.uint32), side="right")[:, :n]
    return found


def replicate_means(
    rows: DataFrame, keys: list[str], by: list[str], values: list[str], n: int = 1000, seed: int = 42
) -> DataFrame:
    """Per group and replicate, the resampled mean of every value column."""
    sums = [f"__sum{i}" for i in range(len(values))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            whole = np.concatenate(list(held.values()))
            out = pd.DataFrame({c: np.repeat(np.array([g[i] for g in held], object), n) for i, c in enumerate(by)})
            out["replicate"] = np.tile(np.arange(n, dtype=np.int32), len(held))
            for i, c in enumerate(["__weight", *sums]):
                out[c] = whole[:, i]
            held.clear()
            return out[out["__weight"] > 0]

        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                weights = draws(part["__key"].tolist(), n, seed)
                amounts = part[values].fillna(0.0).to_numpy(np.float64)
                for group, own in part.groupby(by, dropna=False, sort=False).indices.items():
                    group = group if isinstance(group, tuple) else (group,)
                    group = tuple(None if g != g else g for g in group)
                    total = held.setdefault(group, np.zeros((n, 1 + len(values))))
                    total[:, 0] += weights[own].sum(axis=0)
                    total[:, 1:] += weights[own].T @ amounts[own]
                if len(held) >= GROUPS_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    asked = rows.select(*by, key.alias("__key"), *[F.col(v).cast("double").alias(v) for v in values])
    kinds = dict(rows.select(*by).dtypes)
    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "replicate int", "__weight double", *[f"{c} double" for c in sums]])
    drawn = asked.mapInPandas(run, shape)
    return drawn.groupBy(*by, "replicate").agg(
        *[(F.sum(c) / F.sum("__weight")).alias(v) for c, v in zip(sums, values)]
    )


def row_draws(group: str, rows: int, n: int, seed: int) -> np.ndarray:
    """Row numbers from 0 on: a row per replicate, ``rows`` draws each."""
    total = n * rows
    start = hashlib.md5(f"{seed}|{group}".encode())
    raw = bytearray()
    for block in range(math.ceil(total / REPLICATES_PER_DIGEST)):
        own = start.copy()
        own.update(f"|{block}".encode())
        raw += own.digest()
    found = np.frombuffer(bytes(raw), ">u4")[:total].astype(np.uint64) * np.uint64(rows) >> np.uint64(32)
    return found.reshape(n, rows).astype(np.int64)


def drawn_bounds(
    rows: DataFrame, keys: list[str], by: list[str], values: list[str], n: int, ci: float, seed: int
) -> DataFrame:
    """Per group, ``<value>_bounds`` of the means of ``n`` exact resamples; rows go in the order of ``keys``.

    A group is held whole: for groups of at most :data:`DRAWN` rows.
    """
    kinds = dict(rows.select(*by).dtypes)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    asked = rows.select(*by, name.alias("__group"), *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
                        *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    order = [*by, *[f"__key{i}" for i in range(len(keys))]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            # the last group of a batch may go on in the next
            whole = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if whole is None or not len(whole):
                continue
            marks = whole[by].astype(object).where(whole[by].notna(), None)
            new = np.ones(len(whole), bool)
            new[1:] = [a != b for a, b in itertools.pairwise(marks.itertuples(index=False, name=None))]
            starts = np.flatnonzero(new).tolist()
            ends = [*starts[1:], *([len(whole)] if batch is None else [])]
            rest = None if batch is None else whole.iloc[starts[-1] :]
            out = []
            for a, b in zip(starts, ends):
                picked = row_draws(whole["__group"].iloc[a], b - a, n, seed)
                means = [whole[v].to_numpy(np.float64)[a:b][picked].sum(axis=1) / (b - a) for v in values]
                bounds = [np.percentile(m, [50 * (1 - ci), 50 * (1 + ci)]).tolist() for m in means]
                out.append([*marks.iloc[a].tolist(), *bounds])
            if out:
                yield pd.DataFrame(out, columns=[*by, *[f"{v}_bounds" for v in values]])

    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"{v}_bounds array<double>" for v in values]])
    return asked.repartition(*by).sortWithinPartitions(*order).drop(*order[len(by) :]).mapInPandas(run, shape)


def bootstrap_ci(
    rows: DataFrame,
    keys: list[str],
    by: list[str],
    values: list[str],
    n: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Per group and value column a struct ``<value>_ci`` of mean, lower and upper (4 places).

    ``keys`` name a row and give the order in which rows of a small group are numbered.
    """
    alpha = 1.0 - ci
    # a few numbers per row, read three times, whatever it takes to make them
    rows = materialize(rows.select(*dict.fromkeys([*by, *keys, *values])))
    centre = rows.groupBy(*by).agg(*[F.avg(v).alias(f"{v}_mean") for v in values], F.count(F.lit(1)).alias("__rows"))
    centre = materialize(centre)
    small, large = centre.agg(F.bool_or(F.col("__rows") <= DRAWN), F.bool_or(F.col("__rows") > DRAWN)).first()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    few = many = rows
    if small and large:
        sizes = shared(centre.select(*by, "__rows").withColumnsRenamed({c: f"__{c}" for c in by}))
        sized = rows.join(sizes, same).drop(*[f"__{c}" for c in by])
        few, many = sized.filter(F.col("__rows") <= DRAWN), sized.filter(F.col("__rows") > DRAWN)
    parts = []
    if large:
        means = replicate_means(many, keys, by, values, n, seed)
        ends = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
        parts.append(means.groupBy(*by).agg(*[F.percentile(v, ends).alias(f"{v}_bounds") for v in values]))
    if small or not large:
        parts.append(drawn_bounds(few, keys, by, values, n, ci, seed))
    bounds = reduce(DataFrame.unionByName, parts).withColumnsRenamed({c: f"__{c}" for c in by})
    joined = centre.join(bounds, same, "left").drop(*[f"__{c}" for c in by])
    return joined.select(
        *by,
        *[
            F.struct(
                F.round(F.coalesce(F.col(f"{v}_mean"), F.lit(0.0)), 4).alias("mean"),
                F.round(F.coalesce(F.col(f"{v}_bounds")[0], F.col(f"{v}_mean"), F.lit(0.0)), 4).alias("lower"),
                F.round(F.coalesce(F.col(f"{v}_bounds")[1], F.col(f"{v}_mean"), F.lit(0.0)), 4).alias("upper"),
            ).alias(f"{v}_ci")
            for v in values
        ],
    )
