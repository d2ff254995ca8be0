"""Exact top-k by integer inner product with KD-trees.

The candidates are cut into shards of bounded size.  Each task builds the tree of its
shard: median splits, and a box around the rows of every node.  A block of queries goes
through the tree best first: the bound of a box is the largest inner product that a vector
in it could have, and a node opens only if that can still change the k best.  A first
round asks one shard per block; its k-th scores travel with the queries to all other
shards, and most nodes there stay closed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.llm.common import written

# float64 holds integers exactly up to here.
_EXACT = 2.0**53


@dataclass(frozen=True)
class Sizes:
    """``shard`` rows a tree (expected: rows go by digest), ``leaf`` rows a leaf, ``block`` queries at a time."""

    shard: int = 16_384
    leaf: int = 256
    block: int = 256


class Tree:
    """KD-tree of integer vectors; ids break ties."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        # by id first, so that rows of a leaf, and of equal vectors, stand in order of their ids
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        self.left: list[int] = []
        self.right: list[int] = []
        self.rows: list[np.ndarray | None] = []
        low: list[np.ndarray] = []
        high: list[np.ndarray] = []
        first_id: list[int] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = self.vectors[rows]
            node = len(low)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            first_id.append(int(self.ids[rows[0]]))
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append(None)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = node
            spread = high[node] - low[node]
            if len(rows) <= leaf or not spread.any():
                self.rows[node] = rows
                continue
            # by place in the order of the widest side, so equal values are halved too
            axis = int(spread.argmax())
            middle = len(rows) // 2
            halves = np.argpartition(own[:, axis], middle)
            todo.append((np.sort(rows[halves[:middle]]), node, 0))
            todo.append((np.sort(rows[halves[middle:]]), node, 1))
        self.low, self.high, self.first_id = np.array(low), np.array(high), first_id
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query number, id, score) of the k best of this tree, if they can be among the k best of all.

        ``floors`` holds the k-th score known so far per query.  Rows of the query's own id
        take no part.
        """
        width = self.vectors.shape[1]
        if self.largest * float(np.abs(queries).max(initial=0)) * width < _EXACT:
            kind = np.float64  # exact, and by the fast matrix product
        else:
            kind = np.int64
            if float(self.largest) * float(np.abs(queries).max()) * width >= 2.0**63:
                kind = object  # Python integers
        points, low, high, asked = (x.astype(kind) for x in (self.vectors, self.low, self.high, queries))
        zero = asked * 0
        bounds = np.maximum(asked, zero) @ high.T + np.minimum(asked, zero) @ low.T
        for n in range(len(asked)):
            bound, query, own_id = bounds[n], asked[n], int(query_ids[n])
            floor = floors[n]
            best: list[tuple] = []  # (score, -id), smallest first
            heap = [(-bound[0], 0)]
            while heap:
                worst, node = heapq.heappop(heap)
                if -worst < floor or (len(best) == k and -worst < best[0][0]):
                    break  # no box that is left reaches further
                if len(best) == k and (-worst, -self.first_id[node]) < best[0]:
                    continue  # at best ties, with larger ids
                rows = self.rows[node]
                if rows is None:
                    for child in (self.left[node], self.right[node]):
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                scores = points[rows] @ query
                least = max(floor, best[0][0]) if len(best) == k else floor
                for at in np.flatnonzero(scores >= least):
                    row_id = int(self.ids[rows[at]])
                    if row_id == own_id:
                        continue
                    found = (scores[at], -row_id)
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
            for score, row_id in best:
                yield n, -row_id, int(score)


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double; null if the vector or a component is null or not finite, or no 64-bit integer."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(
        vector,
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**62), F.lit(False)),
    )
    return F.when(vector.isNotNull() & fine, scaled)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, sizes: Sizes = Sizes(),
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long) of each query's k best rows.

    ``is_query`` is a condition on the id column.  Vectors become floor(scale * x) first;
    those that are null or empty, hold null or non-finite components or values beyond
    64-bit integers take no part, and rows without an id neither.  Vectors meet those of
    their own length.  Rows of a query's own id are no candidates for it; other repeated
    rows are candidates each.  A query row that repeats is answered once; one id with
    several vectors is answered for each.  Equal scores: smaller id first.  All candidates
    if fewer than k.
    """
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col), scale).alias("v"), F.col("__query").alias("query")
    )
    rows = written(rows.filter("id is not null and v is not null and size(v) > 0"))
    shards = max(1, math.ceil(rows.count() / sizes.shard))
    candidates = rows.select(
        F.size("v").alias("width"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
        "id", "v", F.lit(None).cast("bigint").alias("floor"),
    )
    # two digests name a query row: its id alone may repeat
    asked = rows.filter("query").select("id", "v").dropDuplicates().withColumn("home", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def at(queries: DataFrame, shard: Column, floor: Column) -> DataFrame:
        return queries.select(F.size("v").alias("width"), shard.alias("shard"), F.lit(1).alias("kind"), "id", "v", floor.alias("floor"))

    first = written(_searched(candidates.union(at(asked, F.col("home"), F.lit(None).cast("bigint"))), k, sizes))
    floors = first.groupBy("query_id", "query_hash").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floors = floors.select("query_id", "query_hash", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    known = asked.join(
        floors, (F.col("id") == F.col("query_id")) & (F.xxhash64("v") == F.col("query_hash")), "left"
    )
    # every query meets every shard but its first: the stated set against all rows, a tree at a time
    others = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("other != home")
    rest = _searched(candidates.union(at(others, F.col("other"), F.col("floor"))), k, sizes)
    by_query = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (
        first.union(rest)
        .withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searched(rows: DataFrame, k: int, sizes: Sizes) -> DataFrame:
    """Best rows of each shard (``kind`` 0) for the queries sent to it (``kind`` 1)."""

    def answer(tree: Tree, queries: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        ids, vectors, floors, hashes = (np.concatenate(c) for c in zip(*queries))
        for start in range(0, len(ids), sizes.block):
            cut = slice(start, start + sizes.block)
            for n, vec_id, score in tree.search(vectors[cut], ids[cut], floors[cut], k):
                yield int(ids[start + n]), int(hashes[start + n]), vec_id, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tree: Tree | None = None
        for batch in batches:
            out: list[tuple] = []
            width, own, kind, ids, hashes = (batch.column(c).to_numpy() for c in ("width", "shard", "kind", "id", "hash"))
            floors = batch.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
            values, offsets = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(width)])
            change = (np.diff(width) != 0) | (np.diff(own) != 0) | (np.diff(kind) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(width)] if len(width) else [0]
            for a, b in zip(edges, edges[1:]):
                if (width[a], own[a]) != shard:
                    shard, held, tree = (width[a], own[a]), [], None
                vectors = values[offsets[a] : offsets[b]].reshape(b - a, width[a])
                if kind[a] == 0:
                    held.append((vectors, ids[a:b]))
                    continue
                if tree is None and held:
                    tree = Tree(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held]), sizes.leaf)
                    held = []
                if tree is not None:
                    out += answer(tree, [(ids[a:b], vectors, floors[a:b], hashes[a:b])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], ["query_id", "query_hash", "vec_id", "score"]
            )

    ordered = (
        rows.withColumn("hash", F.xxhash64("v")).repartition("width", "shard").sortWithinPartitions("width", "shard", "kind")
    )
    return ordered.mapInArrow(run, "query_id bigint, query_hash bigint, vec_id bigint, score bigint")
