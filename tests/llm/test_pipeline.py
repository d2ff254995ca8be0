import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mildtext.llm import jaccard
from test_jaccard import brute as near
from test_packing import check as sequences
from test_packing import one_at_a_time
from test_secrets import base
from test_substring import brute as spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return [d.collect() for d in out]


def test_each_stage_returns_documents(stages):
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == list(corpus_pipeline.COLUMNS)
        assert all(r.n_chars == len(r.text) for r in rows)


def test_decisions_take_effect(spark, stages):
    given, mild, apart, cut, redacted, packed = stages
    from mildtext.llm.queries import op5_toxicity

    toxic = {r.doc_id for r in op5_toxicity(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in mild} == {r.doc_id for r in given} - toxic
    mild = sorted(mild)
    _, component = near([r.text for r in mild])
    assert sorted(apart) == [r for i, r in enumerate(mild) if component[i] == i]
    apart, cut = sorted(apart), sorted(cut)
    for r, before, (n, lost, kept) in zip(cut, apart, spans([r.text for r in apart], 35), strict=True):
        assert r.text == (kept if lost else before.text)
    before = {r.doc_id: r.text for r in cut}
    for r in redacted:
        assert (r.text == before[r.doc_id]) == (not base(before[r.doc_id])) or "[" in r.text
        assert not base(r.text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, lengths = set(), []
    for r in redacted:
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.add((r.doc_id, k, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
            lengths.append(len(ids[at : at + 2048]))
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed} == want
    assert len(sequences(packed)) == len(one_at_a_time(lengths, 2048))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(got) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[-1])


def test_stages_take_any_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, None, None, None, None), (1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, "", "en", "a", 0), (2, "token=abcdefgh", None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for kind in (docs, docs.limit(0)):
        out = kind
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF).cache()
        assert (out.count() > 0) == (kind.count() > 0)


def test_keep_one_of_equal_rows(spark):
    pick = random.Random(1)
    texts = [" ".join(pick.choices("abcdefgh", k=30)) for _ in range(5)]
    rows = [(i % 3, texts[i % 5]) for i in range(40)] + [(None, texts[0]), (None, None), (None, None), (9, ""), (9, " ")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text for r in got if r.text and re.search(r"\S", r.text))) == sorted(texts)
    assert [r.doc_id for r in got if r.text == texts[0]] == [None]
    assert sum(r.text is None for r in got) == 1 and sum(r.doc_id == 9 for r in got) == 2
