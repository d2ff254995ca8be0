"""K-means for all groups, sizes and restarts at once, in whole numbers.

A fit is one size and one restart; all fits of all groups take every step together, in one pass over
the points: a task adds its points to the sums of all centres, the sums meet by centre, and only
centres come to the driver.  Their number is set by parameters (groups x sizes x restarts).

Vectors are whole numbers and so are centres, rounded down.  Distances, sums and ties are thus
exact: a fit depends on the points alone, not on their order, partitions or engine.

The start is k-means|| with samples of a fixed size: from the point of the least draw, every round
takes the ``size`` points with the least draw / squared distance to what was taken, draws being
seeded digests; so a task keeps ``size`` points per fit.  What was taken is weighted by the points
around it, and of these the start is picked one by one: the heaviest, then always that of the largest
weight x squared distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.vectors import SCALE
from mildtext.session import materialize

# Draws: a digest times a power of this, modulo a prime.
LEHMER, PRIME = 48_271, 2**31 - 1
# Rows whose distances to all centres are held together.
ROWS = 512
Group = str | None


@dataclass(frozen=True)
class Fits:
    """Which fits to make: ``sizes`` x ``restarts``, at most ``steps`` steps from a start of ``rounds`` rounds."""

    sizes: tuple[int, ...]
    restarts: int = 10
    steps: int = 20
    rounds: int = 2
    seed: int = 42

    def all(self) -> list[int]:
        """The size of every fit, by number."""
        return [size for size in self.sizes for _ in range(self.restarts)]

    def factor(self, fit: int, turn: int) -> int:
        """What turns a digest into the draw of a fit in its first choice (0) or a round."""
        return pow(LEHMER, 1 + fit * (self.rounds + 1) + turn, PRIME)


#: centres of every fit, by group; a row each
Centres = dict[Group, list[np.ndarray]]


def fixed(vector: Column) -> Column:
    """Components in whole steps of 1 / SCALE."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def points_of(df: DataFrame, ids: list[str], vector: str, group: str | None, seed: int = 42) -> DataFrame:
    """``ids``, ``grp``, ``digest`` and ``vector``, written once.

    ``vector`` is ``array<int>``, see :func:`fixed`; rows without one take no part in what follows.
    """
    digest = F.conv(F.substring(tx.seeded_hash(seed, *map(F.col, ids)), 1, 15), 16, 10).cast("bigint")
    grp = F.col(group).cast("string") if group else F.lit("")
    return materialize(df.select(*ids, grp.alias("grp"), digest.alias("digest"), F.col(vector).alias("vector")))


def _with_vector(points: DataFrame, *more: str) -> DataFrame:
    return points.filter("vector is not null").select(*more, "grp", "digest", "vector")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(group, rows, digests, vectors), rows of one group at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            groups = part.column("grp").to_pylist()
            for group in dict.fromkeys(groups):
                rows = part.take(pa.array([n for n, g in enumerate(groups) if g == group]))
                yield group, rows, rows.column("digest").to_numpy(), _matrix(rows.column("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; whole numbers below 2 ** 53, so exact in any order of summation."""
    return (x * x).sum(axis=1)[:, None] + ((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T))


def _stacked(fits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centres of all fits as one matrix, and where each fit begins and ends in it."""
    return np.concatenate(fits).astype(np.float64), np.concatenate([[0], np.cumsum([len(c) for c in fits])])


def _least(points: DataFrame, fits: Fits, turn: int, taken: Centres) -> dict[tuple[Group, int], np.ndarray]:
    """By group and fit the points of the least keys: draws (``turn`` 0), else draws / squared distances."""
    sizes = fits.all()
    wanted = [1 if turn == 0 else size for size in sizes]
    factors = [fits.factor(n, turn) for n in range(len(sizes))]
    schema = pa.schema([("grp", pa.string()), ("fit", pa.int32()), ("key", pa.float64()), ("digest", pa.int64()), ("vector", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[Group, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for group, _, digests, x in _slices(batches):
            if turn:
                centres, at = _stacked(taken[group])
                squares = np.minimum.reduceat(_squares(x, centres), at[:-1], axis=1)
            for fit, (n, factor) in enumerate(zip(wanted, factors)):
                key = (digests % PRIME * factor % PRIME + 1).astype(np.float64)
                far = np.arange(len(key))
                if turn:
                    far = np.flatnonzero(squares[:, fit] > 0)
                    key = key[far] / squares[far, fit]
                best = key, digests[far], x[far]
                if (group, fit) in held:
                    best = tuple(map(np.concatenate, zip(held[group, fit], best)))
                order = np.lexsort(best[1::-1])[:n]
                held[group, fit] = tuple(b[order] for b in best)
        for (group, fit), (key, digests, x) in held.items():
            columns = [[group] * len(key), [fit] * len(key), key, digests, list(x.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = _with_vector(points).mapInArrow(run, "grp string, fit int, key double, digest bigint, vector array<int>")
    place = F.row_number().over(Window.partitionBy("grp", "fit").orderBy("key", "digest"))
    limits = F.array(*map(F.lit, wanted))
    rows = rows.withColumn("place", place).filter(f"place <= {max(wanted)}").filter(F.col("place") <= F.get(limits, F.col("fit")))
    table = rows.select("grp", "fit", "place", "vector").toArrow().sort_by([("grp", "ascending"), ("fit", "ascending"), ("place", "ascending")])
    found: dict[tuple[Group, int], list] = {}
    for group, fit, vector in zip(*(table.column(c).to_pylist() for c in ("grp", "fit", "vector"))):
        found.setdefault((group, fit), []).append(vector)
    return {key: np.array(vectors, np.int64) for key, vectors in found.items()}


def _sums(points: DataFrame, centres: Centres, active: dict[Group, list[int]]) -> dict[tuple[Group, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group and active fit: points, sums of their vectors and of their squared distances, per centre."""
    schema = pa.schema([("grp", pa.string()), ("slot", pa.int32()), ("n", pa.int64()), ("cost", pa.int64()), ("total", pa.list_(pa.int64()))])
    ddl = "grp string, slot int, n bigint, cost bigint, total array<bigint>"
    ready = {group: _stacked([centres[group][f] for f in fits]) for group, fits in active.items() if fits}

    def batch_of(group: Group, slots: np.ndarray, n: np.ndarray, cost: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel(), pa.int64()))
        columns = [pa.array([group] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(n, pa.int64()), pa.array(cost, pa.int64()), flat]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Group, list[np.ndarray]] = {}
        for group, _, _, x in _slices(batches):
            if group not in ready:
                continue
            matrix, at = ready[group]
            n, cost, total = held.setdefault(group, [np.zeros(len(matrix)), np.zeros(len(matrix)), np.zeros(matrix.shape)])
            squares = _squares(x, matrix)
            for begin, end in zip(at[:-1], at[1:]):
                nearest = squares[:, begin:end].argmin(axis=1)
                n[begin:end] += np.bincount(nearest, minlength=end - begin)
                cost[begin:end] += np.bincount(nearest, squares[np.arange(len(x)), begin + nearest], end - begin)
                order = np.argsort(nearest, kind="stable")
                first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
                total[begin + nearest[order[first]]] += np.add.reduceat(x[order], first)
        for group, (n, cost, total) in held.items():
            some = np.flatnonzero(n)
            yield batch_of(group, some, n[some].astype(np.int64), cost[some].astype(np.int64), total[some].astype(np.int64))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Group, dict[int, list]] = {}
        for batch in batches:
            totals = batch.column("total").flatten().to_numpy().reshape(batch.num_rows, -1)
            for group, slot, n, cost, total in zip(*(batch.column(c).to_pylist() for c in ("grp", "slot", "n", "cost")), totals):
                known = held.setdefault(group, {}).setdefault(slot, [0, 0, np.zeros_like(total)])
                known[0], known[1], known[2] = known[0] + n, known[1] + cost, known[2] + total
        for group, slots in held.items():
            yield batch_of(group, np.array([*slots]), *(np.array(c) for c in zip(*slots.values())))

    partial = _with_vector(points).mapInArrow(add, ddl)
    table = partial.repartition("grp", "slot").mapInArrow(merge, ddl).toArrow()
    out = {}
    for group, (matrix, at) in ready.items():
        rows = table.filter(pc.equal(table["grp"], group) if group is not None else pc.is_null(table["grp"])).combine_chunks()
        slots = rows["slot"].to_numpy()
        n, cost, total = np.zeros(len(matrix), np.int64), np.zeros(len(matrix), np.int64), np.zeros(matrix.shape, np.int64)
        n[slots], cost[slots] = rows["n"].to_numpy(), rows["cost"].to_numpy()
        if len(slots):
            total[slots] = np.stack(rows["total"].to_numpy())
        for fit, begin, end in zip(active[group], at[:-1], at[1:]):
            out[group, fit] = n[begin:end], total[begin:end], cost[begin:end]
    return out


def picked(candidates: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` of weighted candidates: the heaviest, then by weight x squared distance; ties to the first."""
    chosen = [int(weights.argmax())]
    squares = _squares(candidates.astype(np.float64), candidates[chosen].astype(np.float64))[:, 0].astype(np.int64)
    while len(chosen) < size and (score := weights * squares).max() > 0:
        chosen.append(int(score.argmax()))
        new = _squares(candidates.astype(np.float64), candidates[chosen[-1:]].astype(np.float64))[:, 0].astype(np.int64)
        squares = np.minimum(squares, new)
    return candidates[chosen]


def start(points: DataFrame, fits: Fits) -> Centres:
    """First centres of every fit; fewer than its size where a group has fewer different points."""
    first = _least(points, fits, 0, {})
    numbers = range(len(fits.all()))
    taken: Centres = {group: [first[group, n] for n in numbers] for group, _ in first}
    for turn in range(1, fits.rounds + 1):
        more = _least(points, fits, turn, taken)
        taken = {g: [np.concatenate([c, more[g, n]]) if (g, n) in more else c for n, c in enumerate(known)] for g, known in taken.items()}
    weights = _sums(points, taken, {group: [*numbers] for group in taken})
    return {g: [picked(c, weights[g, n][0], fits.all()[n]) for n, c in enumerate(known)] for g, known in taken.items()}


def moved(points: DataFrame, centres: Centres, steps: int) -> Centres:
    """Centres after at most ``steps`` steps; fits that do not move any more take no part.

    A centre without points stays where it is.
    """
    centres = {group: list(fits) for group, fits in centres.items()}
    active = {group: [*range(len(fits))] for group, fits in centres.items()}
    for _ in range(steps):
        found = _sums(points, centres, active)
        active = {group: [] for group in centres}
        for (group, fit), (n, total, _) in found.items():
            old = centres[group][fit]
            new = np.where((n > 0)[:, None], total // np.maximum(n, 1)[:, None], old)
            if (new != old).any():
                centres[group][fit] = new
                active[group].append(fit)
        if not any(active.values()):
            break
    return centres


def best(points: DataFrame, centres: Centres, fits: Fits) -> dict[Group, dict[int, np.ndarray]]:
    """By group and size, the centres of the restart with the least cost; ties to the first."""
    found = _sums(points, centres, {group: [*range(len(known))] for group, known in centres.items()})
    out: dict[Group, dict[int, np.ndarray]] = {}
    for group, known in centres.items():
        for at, size in enumerate(fits.sizes):
            numbers = range(at * fits.restarts, (at + 1) * fits.restarts)
            out.setdefault(group, {})[size] = known[min(numbers, key=lambda n: (int(found[group, n][2].sum()), n))]
    return out


def fit(points: DataFrame, fits: Fits) -> dict[Group, dict[int, np.ndarray]]:
    """Centres by group and size; one pass over the points per round and step, whatever the groups and fits.

    ``points`` as :func:`points_of` gives them.  No points: no groups.
    """
    return best(points, moved(points, start(points, fits), fits.steps), fits)


def assign(points: DataFrame, ids: list[str], centres: dict[Group, dict[int, np.ndarray]]) -> DataFrame:
    """``ids``, ``grp``, ``size``, ``cluster`` and ``square``, the squared distance in steps, per point and size."""
    kinds = [points.schema[c].dataType.simpleString() for c in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows, _, x in _slices(batches):
            for size, known in centres.get(group, {}).items():
                squares = _squares(x, known.astype(np.float64))
                cluster = squares.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in ids], rows.column("grp"), pa.array([size] * len(x), pa.int32()),
                     pa.array(cluster, pa.int32()), pa.array(squares[np.arange(len(x)), cluster].astype(np.int64))],
                    [*ids, "grp", "size", "cluster", "square"],
                )

    return _with_vector(points, *ids).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(ids, kinds)) + ", grp string, size int, cluster int, square bigint")


def near_rows(points: DataFrame, ids: list[str], centres: dict[Group, dict[int, np.ndarray]]) -> DataFrame:
    """For every centre of a size k its k nearest points, wherever they belong: ``ids``, ``grp``, ``size``,
    ``cluster``, ``square`` and ``place`` from 1; ties to the lower digest.  A task keeps k per centre."""
    kinds = [points.schema[c].dataType.simpleString() for c in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for group, rows, digests, x in _slices(batches):
            named = list(zip(*[rows.column(c).to_pylist() for c in ids]))
            for size, known in centres.get(group, {}).items():
                squares = _squares(x, known.astype(np.float64))
                for cluster in range(len(known)):
                    order = np.lexsort((digests, squares[:, cluster]))[:size]
                    new = [(int(squares[n, cluster]), int(digests[n]), named[n]) for n in order]
                    old = held.setdefault((group, size, cluster), [])
                    if len(old) < size or not new or new[0][:2] < old[-1][:2]:
                        held[group, size, cluster] = sorted(old + new, key=lambda r: r[:2])[:size]
        for (group, size, cluster), found in held.items():
            columns = [*zip(*[r[2] for r in found]), [group] * len(found), [size] * len(found), [cluster] * len(found), *list(zip(*found))[:2]]
            types = [points_schema[c] for c in ids] + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*ids, "grp", "size", "cluster", "square", "digest"])

    points_schema = {f.name: f.type for f in points.select(*ids).limit(0).toArrow().schema}
    ddl = ", ".join(f"`{c}` {k}" for c, k in zip(ids, kinds)) + ", grp string, size int, cluster int, square bigint, digest bigint"
    place = F.row_number().over(Window.partitionBy("grp", "size", "cluster").orderBy("square", "digest"))
    return _with_vector(points, *ids).mapInArrow(run, ddl).withColumn("place", place).filter(F.col("place") <= F.col("size"))


def chosen_rows(near: DataFrame, ids: list[str]) -> DataFrame:
    """``ids``, ``grp`` and ``size``: every centre in turn takes the nearest row that none before it took.

    A centre of size k needs its k nearest rows only, for fewer than k can be taken: at most
    k x k rows of a group and size come together.
    """
    schema = near.select(*ids, "grp", "size").schema

    def take(rows: pa.Table) -> pa.Table:
        taken, keep, served = set(), [], set()
        rows = rows.sort_by([("cluster", "ascending"), ("place", "ascending")])
        for n, (cluster, *row) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("cluster", *ids)))):
            if cluster not in served and tuple(row) not in taken:
                served.add(cluster)
                taken.add(tuple(row))
                keep.append(n)
        return rows.take(pa.array(keep, pa.int64())).select([*ids, "grp", "size"])

    return near.groupBy("grp", "size").applyInArrow(lambda rows: take(rows), schema)
