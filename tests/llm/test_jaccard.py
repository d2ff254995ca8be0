import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mildtext.llm import jaccard, wordhash
from mildtext.llm.components import components
from mildtext.llm.queries import op9_jaccard_join
from mildtext.session import BATCH_BYTES


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def smallest(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]


def brute(texts):
    sets = [shingles(t) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for t in s:
            by.setdefault(t, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        for j in {j for t in s for j in by[t] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links.add((j, i))
    return [len(s) for s in sets], smallest(len(texts), links)


def check(got, texts):
    n, component = brute(texts)
    assert sorted(tuple(r) for r in got) == [(i, n[i], component[i]) for i in range(len(texts))]


def test_digests_of_word_ranges():
    pick = random.Random(1)
    texts = [" ".join(pick.choices(["a", "bb", "é", "ccc"], k=pick.randint(0, 30))) for _ in range(60)] + ["", "x"]
    words = wordhash.Words([wordhash.normal(t) for t in texts])
    flat = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert [i for i, _ in flat] == words.text.tolist()
    for k in (1, 3, 5):
        at = words.windows(k)
        assert at.tolist() == [a for a in range(len(flat) - k + 1) if flat[a][0] == flat[a + k - 1][0]]
        digests = words.digest(at, at + k - 1).tolist()
        assert len(set(digests)) == len({tuple(w for _, w in flat[a : a + k]) for a in at})
        assert len(dict(zip(digests, (tuple(w for _, w in flat[a : a + k]) for a in at)))) == len(set(digests))


def family(pick, base, edits):
    words = list(base)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"e{pick.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("how", [jaccard.Join(), jaccard.Join(members=3, sketch=6)])
def test_same_as_brute_force(spark, how):
    pick = random.Random(12)
    texts = [None, "", " \n", "one two", "ONE\ttwo", "one two three", "É b c d e", "é b c d e"]
    for size, copies, edits in ((60, 150, 3), (200, 40, 8), (30, 30, 1), (12, 20, 1)):
        base = [f"w{pick.randint(0, 400)}" for _ in range(size)]
        texts += [family(pick, base, pick.randint(0, edits)) for _ in range(copies)]
    line = " ".join(f"common{i}" for i in range(14))
    texts += [f"{line} " + " ".join(f"u{pick.randint(0, 10**6)}" for _ in range(pick.randint(0, 20))) for _ in range(150)]
    texts += [texts[20]] * 100 + ["long word " * 20_000, "long word " * 20_001]
    pick.shuffle(texts)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(5)
    check(jaccard.join(df, how).collect(), texts)


def test_null_and_repeated_ids(spark):
    same = "a b c d e f g h i j"
    rows = [(None, same), (5, same), (5, "quite another text than that one"), (7, same), (3, "quite another text than that one"), (None, None), (8, "")]
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 6, 5), (5, 6, 5), (5, 2, 3), (7, 6, 5), (3, 2, 3), (None, 0, None), (8, 0, 8)], key=str)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    pick = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)]
    loose = [(pick.randint(200, 400), pick.randint(200, 400)) for _ in range(120)]
    links = chain + star + loose + [(500, 500), (0, 1)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = smallest(501, links)
    assert got == {n: want[n] for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == list(range(len(docs)))
    check(op9_jaccard_join(spark, sf).collect(), [d.text for d in docs])


def test_shingles_shared_by_chance_make_no_lists(spark):
    pick = random.Random(8)
    texts = []
    for pair in range(300):  # two texts with one phrase in common
        for _ in "ab":
            words = [f"w{pick.randint(0, 10**9)}" for _ in range(100)]
            words[40:45] = [f"p{pair}x{i}" for i in range(5)]
            texts.append(" ".join(words))
    alone = len(texts)
    for size, copies, edits in ((40, 20, 2), (200, 30, 10), (12, 20, 1), (5, 4, 1), (3, 3, 0)):
        base = [f"v{pick.randint(0, 400)}" for _ in range(size)]
        texts += [family(pick, base, pick.randint(0, edits)) for _ in range(copies)]
    how = jaccard.Join(sketch=6, tokens=500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    described = jaccard.sets(docs, jaccard.rarity(docs, how), how).cache()
    by_name = {}
    for row in described.collect():
        by_name.setdefault(row.set, []).append(row.doc_id)
    assert len({i for r in jaccard.shared_prefixes(described).collect() for i in by_name[r.set]} & set(range(alone))) > 20
    left = {i for r in jaccard.alive(described.select("set", "n", "prefix"), how).collect() for i in by_name[r.set]}
    assert not left & set(range(alone))
    sets = [shingles(t) for t in texts]
    linked = {
        i for i in range(alone, len(texts)) for j in range(alone, len(texts))
        if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert len(linked) > 20 and linked <= left


def test_workers_get_small_batches(spark):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    jaccard.join(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert int(spark.conf.get(size)) == BATCH_BYTES
