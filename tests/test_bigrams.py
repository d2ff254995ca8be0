"""Word pairs counted by chunks, next to brute force, and what moves between tasks."""

import math

import numpy as np
import pytest

from mildtext.operators import bigrams
from mildtext.operators.score import BigramModel, bigram_perplexity


def brute(corpus, texts, k=0.1):
    pairs, contexts, words = {}, {}, {}
    for lang, text in corpus:
        ws = (text or "").lower().split()
        for a, b in zip(["<s>", *ws], ws):
            pairs[lang, a, b] = pairs.get((lang, a, b), 0) + 1
            contexts[lang, a] = contexts.get((lang, a), 0) + 1
            words.setdefault(lang, set()).add(b)
    out = []
    for lang, text in texts:
        ws = (text or "").lower().split()
        logs = [
            math.log((pairs.get((lang, a, b), 0) + k) / (contexts.get((lang, a), 0) + k * len(words[lang])))
            for a, b in zip(["<s>", *ws], ws) if lang in words
        ]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


CORPUS = [("en", "the cat sat"), ("de", "the cat"), ("en", "The  dog\tsat <s> down"), ("en", ""), ("de", None)] + [("en", "hot pair hot")] * 40
TEXTS = [("en", "the cat sat down"), ("de", "the dog the cat"), ("fr", "the cat"), ("en", " \n"), ("en", None),
         ("en", "hot pair <s> the unknown"), ("en", " hot pair ")]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
@pytest.mark.parametrize("same", [False, True])
def test_chunks_of_any_size(spark, monkeypatch, size, same):
    monkeypatch.setattr(bigrams, "CHUNK_BYTES", size)
    texts = CORPUS if same else TEXTS
    rows = lambda data: spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, lang string, text string")
    asked = rows(texts)
    found = bigram_perplexity(asked, BigramModel(asked if same else rows(CORPUS)), ["id"], same_corpus=same).collect()
    got = {r["id"]: r["ppl"] for r in found}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(CORPUS, texts)):
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_no_row_per_word_moves(spark):
    rows = spark.createDataFrame([(i, "en", "hot pair " * 200) for i in range(50)], "id int, lang string, text string").coalesce(1)
    own = bigrams.chunks(rows, ["id"], "text", "lang").cache()
    assert own.count() == 1
    # the pairs and their contexts: (start, hot), (hot, pair), (pair, hot), and start, hot, pair; then two words
    assert bigrams._blocks(own, bigrams.BOTH).count() <= 8
    plan = bigram_perplexity(rows, BigramModel(rows), ["id"], same_corpus=True)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_numbers_as_bytes():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    assert (bigrams._keys(bigrams._steps(keys)) == keys).all()
    for numbers in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 3]), np.array([1 << 20]), np.array([1 << 40])):
        assert (bigrams._numbers(bigrams._small(numbers)) == numbers).all()
        assert (bigrams._unsqueezed(bigrams._squeezed(numbers)) == numbers).all()
