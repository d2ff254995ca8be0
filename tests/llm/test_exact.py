import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from mildtext.llm import exact


def brute(rows):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in normal:
        same = [k for k, other in normal if other == t]
        keep = min((k for k in same if k is not None), default=None)
        out.append((i, keep, len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    # one row of each group stays, and its id is the smallest
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in got}) == len(kept) and all(r.doc_id == r.keep_id for r in kept)


def corpus(pick, n):
    texts = ["", None, " ", "\n\n", "a", " a", "a ", "a b", "a b", "a\t\x0b b", "A b", "é", "é", "x " * 60_000, "x\n" * 60_000]
    return [(pick.randint(0, 10 * n), pick.choice([*texts[:12], f"t{pick.randint(0, n)}", "same  text"])) for _ in range(n)] + [
        (10 * n + i, t) for i, t in enumerate(texts)
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_brute_force(spark, parts):
    rows = corpus(random.Random(parts), 400) + [(5, "twice"), (5, "twice"), (None, "no id"), (None, "no id"), (None, "same text")]
    df = spark.createDataFrame([(i, t, 1, True, "k") for i, t in rows], "doc_id long, text string, chunk int, kept boolean, sha string")
    got = exact.groups(df.repartition(parts))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(got, rows)


def test_hot_group_over_many_chunks(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    got = exact.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(40))
    check(got, rows)
    assert got.filter("group_size > 1").count() == 1000


def test_empty_table(spark):
    assert exact.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_are_read_without_a_shuffle(spark):
    held = exact._held(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), "doc_id", "text")
    plan = exact._suspects(held)._jdf.queryExecution().executedPlan().toString()
    # what is shuffled: messages to owners, answers to chunks
    assert plan.count("Exchange hashpartitioning(owner") == 1 and plan.count("Exchange hashpartitioning(chunk") == 1


@pytest.mark.parametrize("n, top", [(1, 1), (1, 1 << 50), (2, 3), (500, 500), (5_000, 1 << 30), (40_000, 1 << 24)])
def test_golomb_code(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    coded = exact.encode(values)
    assert (exact.decode(len(values), *coded) == values).all()
    if n >= 5_000:  # near the entropy of the gaps: log2 of the mean gap and two bits
        assert 8 * (len(coded[1]) + len(coded[2])) / len(values) < np.log2(top / n) + 2


def test_suspects_hold_all_copies(spark):
    way = exact.Exchange(10, 3)
    chunks = [pa.table({"chunk": pa.array([c] * 3, pa.int32()), "place": pa.array([0, 1, 2], pa.int32()),
                        "fingerprint": pa.array(f, pa.int64())}) for c, f in enumerate([[1 << 60, -5, 7 << 50], [9 << 55, -5, 3 << 58]])]
    sent = pa.concat_tables([way.send(c) for c in chunks])
    answers = pa.concat_tables([way.answer(sent.filter(pc.equal(sent["owner"], o))) for o in set(sent["owner"].to_pylist())])
    got = [way.receive(c, answers.filter(pc.equal(answers["chunk"], n))).column("suspects").to_pylist() for n, c in enumerate(chunks)]
    assert got == [[[2]], [[2]]]
