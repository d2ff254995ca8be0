import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mildtext.llm import packing
from mildtext.llm.bpe import read_vocabulary
from mildtext.llm.queries import op3_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def one_at_a_time(lengths, capacity):
    """Best-fit decreasing, a document at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(free) if g >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return free


@pytest.mark.parametrize("seed", range(30))
def test_steps_are_best_fit_decreasing(seed):
    pick = random.Random(seed)
    capacity = pick.choice([7, 20, 64])
    lengths = [pick.randint(1, capacity if seed % 2 else max(1, capacity // 3)) for _ in range(pick.randint(1, 200))]
    counts = {n: lengths.count(n) for n in lengths}
    filled = {}
    for length, _, first, each, offset, n in packing.best_fit(counts, capacity):
        for k in range(n):
            assert filled.get(first + k, 0) == offset
            filled[first + k] = offset + each * length
    assert max(filled.values()) <= capacity
    assert sum(filled.values()) == sum(lengths)
    assert sorted(capacity - f for f in filled.values()) == sorted(one_at_a_time(lengths, capacity))


def test_word_ids_are_the_library_s(library):
    pick = random.Random(5)
    letters = "abE 'st\n\t\x85\xa0 \x1c0½éΣςı日,.<|>́"
    texts = ["", "ΟΔΟΣ <|endoftext|> x<|startoftext|>y", "word " * 20000, "a" * 9000]
    texts += ["".join(pick.choices(letters, k=pick.randint(0, 60))) for _ in range(2000)]
    got = packing.WordIds(read_vocabulary(PATH)).encode_many(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def check(rows, capacity=2048):
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    end = {}
    for r in rows:
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert not end or max(end.values()) <= capacity
    return end


def test_query(spark, library):
    rows = op3_best_fit_packing(spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lengths = []
    for d in docs:
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc.pop(d.doc_id), key=lambda r: r.piece)
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        lengths += map(len, cut)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (k, 2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)
        ]
    assert not by_doc
    assert len(check(rows)) == len(one_at_a_time(lengths, 2048))


def test_edge_rows(spark, library):
    vocabulary = read_vocabulary(PATH)
    rows = [(1, None, 5), (1, "", 5), (None, "same words", 5), (2, "same words", 5), (3, "word " * 50, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    cut = packing.pieces(df, vocabulary, capacity=16, keep_ids=True)
    packed = packing.pack(cut, capacity=16)
    got = packed.collect()
    assert len(got) == 4 + 4
    end = check(got, 16)
    whole = packing.sequences(packed).collect()
    assert {r.sequence_id: (r.length, len(r.ids)) for r in whole} == {s: (n, 4 * n) for s, n in end.items()}
    assert packing.pack(packing.pieces(df.filter(F.lit(False)), vocabulary)).count() == 0
