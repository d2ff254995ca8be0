import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mildtext.llm import kdtree
from mildtext.llm.queries import op6_kd_tree_top_k

SF = "/root/testdata/sf0.001"


def brute(rows, k, every=50):
    fine = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * float(x)) for x in v]))
    out = set()
    for q, a in fine:
        if q % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(b) == len(a))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("sizes", [kdtree.Sizes(64, 4, 3), kdtree.Sizes(10_000, 1, 50)])
def test_ties_and_edges(spark, sizes):
    pick = random.Random(8)
    rows = [(i, [float(pick.randint(-2, 2)) / 256 for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [0.01, 0.01, 0.01]) for i in range(200)]  # a third of all rows alike
    rows += [(None, [1.0] * 3), (2000, None), (2001, []), (2002, [1.0, None, 1.0]), (2003, [1.0, float("nan"), 1.0]),
             (2004, [float("inf")] * 3), (50, [0.5, 0.25]), (150, [0.5, 0.25, 0.1]), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    got = [tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0, 5, sizes=sizes).collect()]
    ids = [i for i, _ in rows]
    once = {r for r in got if ids.count(r[0]) == 1}
    assert once == {r for r in brute([(i, np.float32(v).tolist() if v and None not in v else v) for i, v in rows], 5) if ids.count(r[0]) == 1}
    assert kdtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_values_stay_exact():
    pick = random.Random(9)
    vectors = np.array([[pick.randint(-(2**61), 2**61) for _ in range(4)] for _ in range(50)])
    tree = kdtree.Tree(vectors, np.arange(50), 8)
    small = np.array([[1, -1, 0, 1], [0, 0, 0, 0]])
    got = sorted(tree.search(small, np.array([-1, -2]), np.full(2, -(2**63)), 3))
    want = []
    for n, q in enumerate(small.tolist()):
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in enumerate(vectors.tolist()))[:3]
        want += [(n, i, -s) for s, i in best]
    assert got == sorted(want)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op6_kd_tree_top_k(spark, SF).collect()} == brute(rows, 5)
