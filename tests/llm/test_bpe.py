import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from mildtext.llm import bpe
from mildtext.llm.queries import op7_bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
EDGE = ["", " ", "  a  b\n c \n", "<|endoftext|>x <|endoftext|>", "a" * 5000, "I'll don't 's  \t\t\n x",
        "\x85 x\xa0y \x1c z", "ab" * 3000 + " " * 700 + "é" * 900, "日本語 текст 123 ½ ² ́a", "\0 ퟿ \U0001f600",
        "long " * 30000]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(vocabulary, library):
    pick = random.Random(3)
    letters = "ab 'stre\n\t\x85\xa0 \x1c0½é日,.<|>"
    texts = EDGE + ["".join(pick.choices(letters, k=pick.randint(0, 60))) for _ in range(2000)]
    own = bpe.codec(vocabulary)
    got = [np.frombuffer(i, "<u4").tolist() for part in bpe.in_slices(texts) for i in own.encode_many(part)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_cut_as_the_library_does(vocabulary, library):
    own = bpe.codec(vocabulary)
    named = regex.compile(r"[\p{L}\p{N}]")
    codes = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") or named.match(chr(c))]
    texts = ["".join(f"a{c}1{c} {c}" for c in codes[at : at + 100]) for at in range(0, len(codes), 100)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_many(texts)] == [e.ids for e in want]


def test_long_and_short_words_merge_alike(vocabulary):
    own = bpe.codec(vocabulary)
    pick = random.Random(4)
    for _ in range(200):
        word = "".join(pick.choices("theinaron", k=pick.randint(1, 120)))
        parts = [own.byte_id[b] for b in word.encode()]
        (_, ids), = [x for x in own._merge_short(np.array([parts]))]
        assert ids[0].tolist() == own._merge_long(list(parts))


def test_full_tables_start_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.Codec(vocabulary)
    first = [own.encode(t) for t in ("one two three four", "five six")]
    assert first == [own.encode(t) for t in ("one two three four", "five six")]


def test_nulls_repeats_and_clashing_columns(spark, vocabulary, library):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, None), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encode(df, vocabulary).collect(), key=str)
    ids = np.array(library.encode("a b").ids, "<u4").tobytes()
    assert sorted([(1, ids), (1, ids), (None, b""), (2, b"")], key=str) == sorted([(r[0], bytes(r[1])) for r in got], key=str)
    back = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert sorted(r.decoded for r in back.collect()) == ["", "", "a b", "a b"]
    assert bpe.round_trip(df.limit(0), vocabulary).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in op7_bpe_round_trip(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
