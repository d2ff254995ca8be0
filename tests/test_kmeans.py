"""Hashed vectors, grouped K-means and samples by clusters, next to plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mildtext.config import PrepConfig
from mildtext.operators import diversity, kmeans, vectors
from mildtext.plans.prepare_all import few_shot_subsets


def plain_counts(text, width=vectors.WIDTH):
    out = [0] * width
    text = " " + " ".join(text.lower().split()) + " "
    for a, b, c in zip(text, text[1:], text[2:]):
        number = ((ord(a) * vectors.BASE + ord(b)) % vectors.PRIME * vectors.BASE + ord(c)) % vectors.PRIME
        out[number % width] += 1 - 2 * (number // width % 2)
    return out


TEXTS = ["", " ", "a", "ab cd", "Ab  Cd\n", "äöü ß 漢字 😀", "the same the same the same", "x" * 5000, None]


def test_hashed_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHARS_AT_ONCE", 50)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r.vector for r in vectors.hashed_vectors(df, "text").collect()}
    for i, text in enumerate(TEXTS):
        counts = plain_counts(text or "")
        length = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert got[i] == [math.floor(vectors.SCALE * c / length) for c in counts]
    assert got[3] == got[4] and not any(got[0]) and got[0] == got[8]


def test_hashed_similarity(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(pairs, "id int, a string, b string").withColumn("sim", F.lit("old"))
    got = {r.id: r.sim for r in vectors.hashed_similarity(df, "a", "b").collect()}
    for i, a, b in pairs:
        x, y = plain_counts(a or ""), plain_counts(b or "")
        norm = math.sqrt(sum(c * c for c in x)) * math.sqrt(sum(c * c for c in y))
        assert got[i] == pytest.approx(sum(c * d for c, d in zip(x, y)) / norm if norm else 0.0)


def digest(*ids, seed=42):
    return int(hashlib.md5("|".join(map(str, (seed, *ids))).encode()).hexdigest()[:15], 16)


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_fit(rows, size, fits, number):
    """Centres and cost of one fit over (id, vector)."""
    draw = [lambda i, f=fits.factor(number, t): digest(i) % kmeans.PRIME * f % kmeans.PRIME + 1 for t in range(fits.rounds + 1)]
    taken = [min(rows, key=lambda r: (draw[0](r[0]), digest(r[0])))[1]]
    for t in range(1, fits.rounds + 1):
        far = [(min(square(v, c) for c in taken), i, v) for i, v in rows]
        order = sorted((draw[t](i) / d, digest(i), v) for d, i, v in far if d > 0)
        taken += [v for _, _, v in order[:size]]
    weight = [0] * len(taken)
    for _, v in rows:
        weight[min(range(len(taken)), key=lambda j: (square(v, taken[j]), j))] += 1
    centres = [taken[max(range(len(taken)), key=lambda j: (weight[j], -j))]]
    while len(centres) < size:
        score = [w * min(square(c, o) for o in centres) for w, c in zip(weight, taken)]
        if max(score) == 0:
            break
        centres.append(taken[score.index(max(score))])
    for _ in range(fits.steps):
        own = [min(range(len(centres)), key=lambda j: (square(v, centres[j]), j)) for _, v in rows]
        new = []
        for j, c in enumerate(centres):
            mine = [v for (_, v), o in zip(rows, own) if o == j]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        centres = new
    return centres, sum(min(square(v, c) for c in centres) for _, v in rows)


def plain_sample(rows, size, fits):
    at = fits.sizes.index(size) * fits.restarts
    found = [plain_fit(rows, size, fits, at + n) for n in range(fits.restarts)]
    centres = min(enumerate(found), key=lambda f: (f[1][1], f[0]))[1][0]
    taken = []
    for c in centres:
        near = sorted((square(v, c), digest(i), i) for i, v in rows if i not in taken)
        taken += [i for _, _, i in near[:1]]
    rest = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, _ in rows if i not in taken)
    return sorted((taken + [i for _, i in rest])[:size])


def clouds(pick, n, first=0):
    hubs = [[pick.randint(-2000, 2000) for _ in range(6)] for _ in range(4)]
    return [(first + i, [h + pick.randint(-150, 150) for h in pick.choice(hubs)]) for i in range(n)]


FITS = kmeans.Fits((3, 8), restarts=2, steps=4)


@pytest.mark.parametrize("parts", [1, 5])
def test_samples_of_groups_are_those_of_plain_python(spark, parts):
    pick = random.Random(parts)
    groups = {"a": clouds(pick, 70), "b": clouds(pick, 25, 1000), "few": clouds(pick, 5, 2000),
              "same": [(3000 + i, [7] * 6) for i in range(12)], None: clouds(pick, 20, 4000)}
    rows = [(i, g, v) for g, known in groups.items() for i, v in known] + [(5000, "a", None)]
    df = spark.createDataFrame(rows, "id long, lang string, vector array<int>").repartition(parts)
    got = {}
    for r in diversity.cluster_samples(df, FITS, ["id"], "vector", "lang").collect():
        got.setdefault((r.grp, r.size), []).append(r.id)
    for g, known in groups.items():
        for size in FITS.sizes:
            assert sorted(got[g, size]) == plain_sample(known, size, FITS), (g, size)


def test_assign_and_no_points(spark):
    known = clouds(random.Random(3), 60)
    df = spark.createDataFrame([(i, v) for i, v in known], "id long, vector array<int>")
    points = kmeans.points_of(df, ["id"], "vector", None)
    centres = kmeans.fit(points, FITS)
    for r in kmeans.assign(points, ["id"], centres).collect():
        v = dict(known)[r.id]
        squares = [square(v, c) for c in centres[""][r["size"]].tolist()]
        assert (r.square, r.cluster) == (min(squares), squares.index(min(squares)))
    empty = kmeans.points_of(df.limit(0), ["id"], "vector", None)
    assert kmeans.fit(empty, FITS) == {} and kmeans.assign(empty, ["id"], {}).collect() == []
    assert diversity.cluster_samples(df.limit(0), FITS, ["id"], "vector").collect() == []


def test_whole_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25, 1e-9]), (2, None)], "id int, v array<float>")
    assert [r.v for r in diversity.whole_numbers(df, "v").orderBy("id").collect()] == [[2048, -1024, 0], None]


def test_jobs_do_not_grow_with_groups(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(groups):
        name = f"jobs-{groups}"
        spark.sparkContext.setJobGroup(name, name)
        rows = [(100 * g + i, f"g{g}", v) for g in range(groups) for i, v in clouds(random.Random(1), 30)]
        df = spark.createDataFrame(rows, "pair_id long, lang string, vector array<int>")
        cfg = PrepConfig(target_langs=tuple(f"g{g}" for g in range(groups)), few_shot_sizes=(3, 5))
        got = few_shot_subsets(df, cfg, "vector", ["pair_id"], n_init=2, steps=2).groupBy("lang", "n_shots").count().collect()
        assert sorted((r.lang, r.n_shots, r["count"]) for r in got) == sorted((f"g{g}", n, n) for g in range(groups) for n in (3, 5))
        return len(tracker.getJobIdsForGroup(name))

    one, more = jobs(1), jobs(6)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more <= one + 3


def test_exact_distances():
    x = np.random.default_rng(1).integers(-4096, 4097, (50, 256)).astype(float)
    want = [[square(a, b) for b in x[:7].astype(int).tolist()] for a in x.astype(int).tolist()]
    assert kmeans._squares(x, x[:7]).tolist() == want
