import hashlib
import random
import re
from collections import Counter

import pytest

from mildtext.llm import substring
from mildtext.llm.queries import op1_substring_dedup


def brute(texts, k):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in cut for i in range(len(w) - k + 1))
    out = []
    for w in cut:
        gone = {i + j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(got, texts, k):
    want = brute(texts, k)
    got = {r.doc_id: (r.n_words, r.n_removed, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in got}
    assert got == dict(enumerate(want))


def corpus(pick, n):
    texts = []
    passage = [f"p{i}" for i in range(80)]
    for _ in range(n):
        words = [f"w{pick.randint(0, 50)}" for _ in range(pick.randint(0, 120))]
        for _ in range(pick.randint(0, 2)):
            a = pick.randint(0, 60)
            words[pick.randint(0, len(words)) :][:0] = []
            at = pick.randint(0, len(words))
            words[at:at] = passage[a : a + pick.randint(5, 60)]
        if texts and pick.random() < 0.3:
            words = pick.choice(texts).split()
            if words and pick.random() < 0.7:
                words[pick.randrange(len(words))] = "edit"
        texts.append(" ".join(words) if pick.random() < 0.8 else "\n".join(words))
    return texts


@pytest.mark.parametrize("how", [substring.Spans(), substring.Spans(12, 4), substring.Spans(9, 3, passages=2, shard=50)])
def test_same_as_brute_force(spark, how):
    pick = random.Random(how.words)
    texts = corpus(pick, 250) + [None, "", " \n", "a b " * 300, "x " * 34, "x " * 35, "x " * 36, "y " * 35, "é " * 20_000]
    texts += ["same text " + " ".join(f"s{i}" for i in range(40))] * 120
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, row string").repartition(6)
    got = substring.remove(df, how)
    assert got.columns == ["doc_id", "text", "row", "n_words", "n_removed"]
    check(got.collect(), texts, how.words)


def test_automaton_counts_are_those_of_brute_force():
    pick = random.Random(5)
    for _ in range(200):
        sequences = [pick.choices("ab", k=pick.randint(1, 9)) for _ in range(pick.randint(1, 6))]
        weights = [pick.randint(1, 2) for _ in sequences]
        automaton = substring.Automaton()
        for s, w in zip(sequences, weights):
            automaton.add(s, w)
        automaton.close()
        times = Counter()
        for s, w in zip(sequences, weights):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    times["".join(s[a:b])] += w
        for s in [*sequences, pick.choices("ab", k=12)]:
            want = [max([n for n in range(i + 2) if n and times["".join(s[i + 1 - n : i + 1])] >= 2], default=0) for i in range(len(s))]
            assert list(automaton.statistics(s)) == want


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long + " tail"), (1, long), (1, "short"), (1, "short"), (2, None)]
    got = sorted((tuple(r) for r in substring.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, "", 40, 40), (None, "tail", 41, 40), (1, "", 40, 40), (1, "short", 1, 0), (1, "short", 1, 0), (2, None, 0, 0)], key=str)
    assert substring.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_equal_upper_digest_halves_stay(spark):
    tail = " ".join(f"v{i}" for i in range(34))
    pairs = [(114720, 201989), (135048, 7006), (238126, 145204)]
    texts = [f"u{n} {tail}" for pair in pairs for n in pair]
    found = substring.Passages([t.encode() for t in texts], substring.Spans())
    assert len(set((found.digest >> 32).tolist())) == 3 and len(set(found.digest.tolist())) == 6 and len(set(found.anchor.tolist())) == 1
    for given in (texts[:2], texts, texts + [texts[0]]):
        df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
        check(substring.remove(df).collect(), given, 35)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute([d.text for d in docs], 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf).collect()}
    assert got == {d.doc_id: (w[0], w[1], hashlib.sha256(w[2].encode()).hexdigest()) for d, w in zip(docs, want)}
