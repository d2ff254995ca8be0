import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mildtext.llm import periods
from mildtext.llm.queries import op12_periodic_runs


def brute(words, least=12):
    """All runs, by walking along every period."""
    n, found = len(words), {}
    for q in range(n // 2, 0, -1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found[i, j + q - i] = q  # smaller periods come later
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def some_words(pick):
    n, letters = pick.choice([0, 1, 2, 11, 12, 13, 40, 150]), pick.choice([1, 2, 3, 30])
    words = [pick.randrange(letters) for _ in range(n)]
    if n and pick.random() < 0.6:
        a = pick.randrange(n)
        p = pick.randint(1, max(1, (n - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [12, 5, 1])
def test_runs_are_those_of_brute_force(least):
    pick = random.Random(least)
    for _ in range(60):
        texts = [some_words(pick) for _ in range(pick.randint(1, 8))]
        got = periods.find_runs([np.array(t, np.int64) for t in texts], least)
        assert [[tuple(r) for r in runs.tolist()] for runs in got] == [brute(t, least) for t in texts]


def test_pairs_in_small_parts(monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", 50)
    pick = random.Random(9)
    texts = [some_words(pick) for _ in range(40)] + [[0] * 300]
    got = periods.find_runs([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in runs.tolist()] for runs in got] == [brute(t) for t in texts]


def test_cover_has_every_difference():
    differences = {(a - b) % periods.MODULUS for a in periods.COVER for b in periods.COVER}
    assert differences == set(range(periods.MODULUS))


def test_common_extension():
    pick = random.Random(4)
    for _ in range(30):
        ids = np.array(some_words(pick) + some_words(pick), np.int64)
        n = len(ids)
        if n < 2:
            continue
        extend = periods.CommonExtension(ids)
        a = np.array([pick.randint(0, n) for _ in range(200)])
        b = np.array([pick.randint(0, n) for _ in range(200)])
        a, b = a[a != b], b[a != b]
        want = [next(d for d in range(n + 1) if max(x, y) + d >= n or ids[x + d] != ids[y + d]) for x, y in zip(a, b)]
        assert extend(a, b).tolist() == want


def test_collapse(spark):
    pick = random.Random(2)
    texts = [" ".join(f"w{x}" for x in some_words(pick)) for _ in range(120)]
    texts += [None, "", " \n\t", "a b " * 9, "x " * 12, "x\n" * 11, "again and " * 8, "again and " * 8, "long " * 60_000]
    texts += ["\x1ca \x1cb " * 20]  # white space elsewhere, letters here
    df = spark.createDataFrame([(i // 2, t, 1, "r") for i, t in enumerate(texts)], "doc_id int, text string, n_words int, runs string")
    got = periods.collapse(df.repartition(3))
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    rows = []
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        rows.append((i // 2, len(words), runs, collapsed(words, runs)))
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect()) == sorted(rows)
    assert periods.collapse(df.limit(0)).collect() == []


def test_query(spark, tmp_path):
    pick = random.Random(11)
    rows = [(i, " ".join(f"w{x}" for x in some_words(pick))) for i in range(400)]
    rows += [(10_000 + i, t) for i, t in enumerate([None, "", "\n", *["a b"] * 40])] + [(None, "x " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for doc_id, text in rows:
        words = planted(doc_id, text) if doc_id is not None else text.split()
        changed += words != (text or "").split()
        runs = brute(words)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert changed > 10
    assert dict(op12_periodic_runs(spark, str(tmp_path)).dtypes)["exponent_milli"] == "bigint"
